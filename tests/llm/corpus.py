"""A small corpus with copies, near copies, shared passages, nulls, blanks and repeated rows."""

import random

PARTS = {"en": "the and ing tion re th er an".split(), "de": "der und ung schen keit ß ein ge".split(), "fr": "les et eau tion é que ou ch".split()}


def words(r, n, lang="en"):
    return ["".join(r.choices(PARTS[lang], k=r.randint(1, 3))) for _ in range(n)]


def documents(seed=5, count=60):
    """Rows (doc_id, text, lang, source, n_chars)."""
    r = random.Random(seed)
    passage = " ".join(words(r, 70))
    texts = []
    for k in range(count):
        lang = ("en", "en", "de", "fr")[k % 4]
        lines = [" ".join(words(r, r.randint(1, 90), lang)) for _ in range(r.randint(1, 4))]
        if k % 7 == 0:
            lines.insert(r.randint(0, len(lines)), passage)
        texts.append(("\n".join(lines), lang))
    for k in range(8):  # copies and near copies
        text, lang = texts[r.randrange(count)]
        w = text.split(" ")
        if k % 2:
            w[r.randrange(len(w))] = "changed"
        texts.append((" ".join(w), lang))
    texts += [(None, None), ("", "en"), ("  \n\t ", None), ("1234 !!", "en"), ("x", "en"), ("é", None), ("word " * 200, "en"), (texts[0][0] * 40, "en")]
    rows = [(k, t, x, f"s{min(k % 5, 2)}", len(t or "")) for k, (t, x) in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def saved(spark, folder, rows=None):
    """A folder with ``documents.parquet`` for the registered queries."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
