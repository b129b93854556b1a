"""Small documents with every kind of odd row, and an independent session helper."""

from __future__ import annotations

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a  b",
    "a \n b",
    " x",
    "x ",
    "foo\n bar baz.\n\nqux,\tend",
    "it's we'll DON'T 'S 'll",
    "<|endoftext|> a  <|endoftext|>b",
    "<|startoftext|>Hi",
    "İstanbul ΣΑΣ Σ ς",
    "a\x1cb \x1d c \x85y \x85z",
    "e\u0301 \u0301a \u00e9 \u00c9T\u00c9",
    "日本語 テスト 123 ²³ ½",
    "aaaa aaa aa a aaaaaaaaaaaaaaaaaaaaaaaa",
    "!!?? ... --- ### %%%",
    "The and Of THE; the. (the) the's",
    "🙂🙂 👩‍👩‍👧 x🙂y",
    "word " * 3000,
    "z" * 5000,
    "The and of the",
    "The and of the",
]


def docs(spark, texts=ODD_TEXTS, start=0):
    """Documents with null and repeated ids, and extra columns whose names clash with inner ones."""
    rows = [(start + i, t, "en", "src0", len(t or ""), "x", 1, 2.0) for i, t in enumerate(texts)]
    rows.append((None, "A text without an id.", "en", None, 5, "x", 1, 2.0))
    rows.append(rows[min(3, len(texts) - 1)])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, score double")


def empty(spark):
    return docs(spark).limit(0)
