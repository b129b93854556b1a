"""Request lines and response lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A request is an object with one member, named for its kind (fixed values of the protocol).
LINE = "Put struct<key:string,value:string>, Get struct<key:string>, Del struct<key:string>"


def parse_requests(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds op, key and value; op is null for a line that is no put, get or delete."""
    body = F.from_json(F.col(line), LINE)
    parsed = lines.withColumn("_r", body)
    op = F.when(F.col("_r.Put").isNotNull(), "PUT").when(F.col("_r.Get").isNotNull(), "GET").when(F.col("_r.Del").isNotNull(), "DEL")
    return parsed.withColumn("op", op).withColumn("key", F.coalesce("_r.Put.key", "_r.Get.key", "_r.Del.key")).withColumn("value", F.col("_r.Put.value")).drop("_r")


#: Kinds of requests without a body, which are lines of one JSON string, and those with one (fixed values of the protocol).
BARE_KINDS = ["Stats", "MemtableDump", "Close", "ListSst", "FlushNow", "ManifestInfo", "VersionInfo", "CompactionStats", "CompactionPause", "CompactionResume", "BgStatus"]
BODY_KINDS = ["Put", "Get", "Del", "Configure", "CompactionRun", "Shutdown"]


def parse_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds kind (of all requests), files (of CompactionRun; null: the picker chooses), graceful (of Shutdown) and settings (of Configure, as text by name); kind is null for any other line."""
    bodies = F.from_json(F.col(line), "map<string,string>")
    bare = F.regexp_extract(F.trim(F.col(line)), '^"([A-Za-z]+)"$', 1)
    name = F.map_keys(bodies)[0]
    kind = F.when(bare.isin(BARE_KINDS), bare).when((F.size(bodies) == 1) & name.isin(BODY_KINDS), name)
    of = lambda k, schema: F.when(F.col("kind") == k, F.from_json(F.map_values(bodies)[0], schema))
    return lines.withColumn("kind", kind).withColumns({"files": of("CompactionRun", "files array<bigint>")["files"], "graceful": of("Shutdown", "graceful boolean")["graceful"], "settings": of("Configure", "map<string,string>")})


def response_lines(results: DataFrame) -> DataFrame:
    """Adds line: one JSON object with Ok or Error and the message. results: status, message."""
    return results.withColumn("line", F.when(F.col("status") == "OK", F.to_json(F.struct(F.col("message").alias("Ok")))).otherwise(F.to_json(F.struct(F.col("message").alias("Error")))))
