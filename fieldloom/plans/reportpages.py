"""Harvest reports of the bench tables as portable documents: input of the queries that read such documents.

A publisher (nation) has a document for each season: a cover and a page with the running
totals of that season and the one before, by period and region. Spark makes the
totals; tasks write one document from the pieces of each.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar
from .panel import SHIFT, moved, table

#: Size of a page; of its letters, whose widths are all 600 of 1000.
WIDTH, HEIGHT, SIZE, LETTER = 900, 600, 8, 0.6
# The title of the table's page, and its headers with their places on this page.
TITLE = "Histórico da moagem quinzenal, ACUMULADA, da região Centro-Sul"
#: Left ends of the words of a cell, by column.
CELLS = tuple((c - 100, c - 30, c + 40) for c in (280, 510, 740))
HEADS = (("Quinzena", 30, 60), ("São", 258, 60), ("Paulo", 280, 60), ("Centro-Sul", 486, 60), ("Demais", 710, 60), ("Estados", 745, 60))
#: Month and day on which the periods of a season end, from the first (31: the month's last, 28 February in every year).
ENDS = tuple((m, d) for m in (4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3) for d in (16, 31))


def _pdf(pages: list[list[dict]]) -> bytes:
    """A document of pieces ``(text, x, top)``: letters beyond ASCII by a font with two-byte codes and a table to Unicode, others by one of one byte."""
    objects: list[bytes] = []
    wide = sorted({ch for page in pages for w in page for ch in w["text"] if ord(ch) > 126})
    code = {ch: k + 1 for k, ch in enumerate(wide)}

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, more: bytes = b"") -> int:
        packed = zlib.compress(data)
        return add(b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(packed), more, packed))

    root, tree = add(b""), add(b"")
    widths = b" ".join([b"600"] * 95)
    plain = add(b"<< /Type /Font /Subtype /TrueType /BaseFont /Plain /FirstChar 32 /LastChar 126 /Widths [%s] /Encoding /WinAnsiEncoding >>" % widths)
    pairs = "\n".join(f"<{c:04X}> <{ch.encode('utf-16-be').hex()}>" for ch, c in code.items())
    unicode = stream(f"1 begincodespacerange <0000> <FFFF> endcodespacerange {len(code)} beginbfchar\n{pairs}\nendbfchar".encode())
    inner = add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /DW 500 /W [1 %d 600] >>" % max(len(code), 1))
    other = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, unicode))
    kids = []
    for page in pages:
        out = [b"q 1 0 0 1 0 0 cm BT"]
        for w in page:
            out.append(b"1 0 0 1 %g %g Tm" % (w["x"], HEIGHT - w["top"] - SIZE))
            parts: list[tuple[bool, str]] = []
            for ch in w["text"]:
                if parts and parts[-1][0] == (ch in code):
                    parts[-1] = (parts[-1][0], parts[-1][1] + ch)
                else:
                    parts.append((ch in code, ch))
            for beyond, text in parts:
                shown = "<" + "".join(f"{code[ch]:04X}" for ch in text) + ">" if beyond else "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
                out.append(f"/{'W' if beyond else 'P'} {SIZE} Tf {shown} Tj".encode())
        content = stream(b"\n".join([*out, b"ET Q"]))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /Resources << /Font << /P %d 0 R /W %d 0 R >> >> >>" % (tree, content, plain, other)))
    objects[root - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d %d] >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids), WIDTH, HEIGHT)
    data, places = bytearray(b"%PDF-1.5\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    rows = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(data) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, rows, len(objects) + 1, root, len(data))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(publisher, year, period_end_date, number, region, total)``: running totals of each season that starts in ``year``, at each of its periods up to the newest order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", moved("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    orders = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    region = F.when(F.col("o_orderstatus") == "F", "sao_paulo").when(F.col("o_orderstatus") == "O", "other_states").otherwise("centre_south")
    year = F.year("day") - F.when(F.month("day") < calendar.HARVEST_MONTH, 1).otherwise(0)
    number = F.pmod(F.month("day") - 4, F.lit(12)) * 2 + F.when(F.dayofmonth("day") > 16, 1).otherwise(0)
    sums = orders.groupBy(F.col("c_nationkey").alias("publisher"), year.alias("year"), number.alias("number"), region.alias("region")).agg(F.sum("price").cast("bigint").alias("tonnes"), F.max("day").alias("newest"))
    ends = F.array(*(F.struct(F.lit(k).alias("number"), F.lit(m).alias("m"), F.lit(d).alias("d")) for k, (m, d) in enumerate(ENDS)))
    seasons = sums.select("year").distinct().select("year", F.explode(ends).alias("e"))
    first = F.make_date(F.col("year") + F.when(F.col("e.m") < 4, 1).otherwise(0), F.col("e.m"), F.lit(1))
    seasons = seasons.select("year", "e.number", F.when(F.col("e.d") == 16, F.date_add(first, 15)).when(F.col("e.m") == 2, F.date_add(first, 27)).otherwise(F.last_day(first)).alias("period_end_date"))
    # One row: the newest day.
    newest = sums.agg(F.max("newest").alias("newest"))
    seasons = seasons.crossJoin(F.broadcast(newest)).where(F.date_add("period_end_date", -16) < F.col("newest")).drop("newest")
    publishers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("publisher"))
    regions = publishers.select("publisher", F.explode(F.array(*(F.lit(r) for r in ("sao_paulo", "centre_south", "other_states")))).alias("region"))
    # Calendar rows are few and the same at every size: 24 for each season of each publisher and region.
    grid = regions.join(seasons)
    window = Window.partitionBy("publisher", "year", "region").orderBy("number")
    both = grid.join(sums.drop("newest"), ["publisher", "year", "number", "region"], "left")
    return both.select("publisher", "year", "period_end_date", "number", "region", F.sum(F.coalesce("tonnes", F.lit(0))).over(window).cast("bigint").alias("total"))


def _dotted(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, page, text, x, top)`` of every word of the reports."""
    every = totals(spark, sf_dir)
    old = every.select("publisher", (F.col("year") + 1).alias("year"), "number", "region", F.col("total").alias("before"))
    both = every.join(old, ["publisher", "year", "number", "region"])
    tenths = F.when(F.col("before") == 0, 0).otherwise(F.expr("abs(total - before) * 1000 div before"))
    change = F.concat(F.expr("cast(tenths div 10 as string)"), F.lit(","), (F.col("tenths") % 10).cast("string"), F.lit("%"))
    both = both.withColumn("tenths", tenths).withColumn("doc", F.concat(F.lit("report-"), F.col("publisher").cast("string"), F.lit("-"), F.col("year").cast("string")))
    place = F.when(F.col("region") == "sao_paulo", 0).when(F.col("region") == "centre_south", 1).otherwise(2)
    top = (F.lit(100) + F.col("number") * 14).cast("double")
    word = lambda text, x, at: F.struct(text.alias("text"), x.cast("double").alias("x"), at.cast("double").alias("top"))
    xs = [F.get(F.array(*(F.lit(c[k]) for c in CELLS)), place) for k in range(3)]
    cell = F.array(word(_dotted(F.col("before")), xs[0], top), word(_dotted(F.col("total")), xs[1], top), word(change, xs[2], top))
    period = F.when(F.col("region") == "sao_paulo", F.array(word(F.date_format("period_end_date", "dd/MM"), F.lit(36), top))).otherwise(F.array())
    data = both.select("doc", F.lit(1).alias("page"), F.explode(F.concat(cell, period)).alias("w"))
    pair = lambda y: F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string"))
    title = [(w, 30 + 60 * k, 20) for k, w in enumerate(TITLE.split(" "))]
    names = [word(pair(F.col("year") - 1 + k), F.lit(c[k]), F.lit(78 + k)) for c in CELLS for k in (0, 1)]
    heads = both.select("doc", "year").distinct()
    pages = [(1, F.array(*(word(F.lit(t), F.lit(x), F.lit(y)) for t, x, y in (*title, *HEADS)), *names)), (0, F.array(word(F.lit("Relatório"), F.lit(30), F.lit(40)), word(F.lit("(final)"), F.lit(90), F.lit(40)), word(pair(F.col("year")), F.lit(150), F.lit(41))))]
    heads = heads.select("doc", F.explode(F.array(*(F.struct(F.lit(p).alias("page"), w.alias("words")) for p, w in pages))).alias("p"))
    return data.unionByName(heads.select("doc", "p.page", F.explode("p.words").alias("w"))).select("doc", "page", "w.*")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, content)``."""
    own = pieces(spark, sf_dir).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "top", "x", "text"))).alias("words"))

    def write(batches):
        for batch in batches:
            made = []
            for words in batch.column("words").to_pylist():
                made.append(_pdf([[w for w in words if w["page"] == k] for k in range(words[-1]["page"] + 1)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.binary())], names=["doc", "content"])

    return own.mapInArrow(write, "doc string, content binary")


_REGIONS = "(VALUES ('sao_paulo', 0), ('centre_south', 1), ('other_states', 2)) AS r(region, place)"
#: ``t``: running totals; ``b``: rows of reports, with the totals of the season before.
TOTALS_SQL = f"""o AS (SELECT c_nationkey AS publisher, CASE o_orderstatus WHEN 'F' THEN 'sao_paulo' WHEN 'O' THEN 'other_states' ELSE 'centre_south' END AS region,
  (o_orderdate + INTERVAL {SHIFT} YEAR)::DATE AS day, o_totalprice::DECIMAL(12,2) AS price FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, year(day) - CASE WHEN month(day) < 4 THEN 1 ELSE 0 END AS y, ((month(day) + 8) % 12) * 2 + CASE WHEN day(day) > 16 THEN 1 ELSE 0 END AS number FROM o),
s AS (SELECT publisher, y, number, region, floor(sum(price))::BIGINT AS tonnes FROM p GROUP BY ALL),
e AS (SELECT y, k AS number, CASE WHEN k % 2 = 0 THEN make_date(yy, m, 16) WHEN m = 2 THEN make_date(yy, 2, 28) ELSE last_day(make_date(yy, m, 1)) END AS period_end_date
  FROM (SELECT y, k, (k // 2 + 3) % 12 + 1 AS m, y + CASE WHEN k >= 18 THEN 1 ELSE 0 END AS yy FROM (SELECT DISTINCT y FROM s), range(24) AS g(k))),
t AS (SELECT n_nationkey AS publisher, e.y, e.number, e.period_end_date, r.region, place, sum(coalesce(tonnes, 0)) OVER (PARTITION BY n_nationkey, e.y, r.region ORDER BY e.number)::BIGINT AS total
  FROM nation, {_REGIONS}, e LEFT JOIN s ON s.publisher = n_nationkey AND s.y = e.y AND s.number = e.number AND s.region = r.region
  WHERE e.period_end_date - 16 < (SELECT max(day) FROM o)),
b AS (SELECT 'report-' || n.publisher || '-' || n.y AS doc, n.*, old.total AS before, CASE WHEN old.total = 0 THEN 0 ELSE abs(n.total - old.total) * 1000 // old.total END AS tenths
  FROM t AS n JOIN t AS old ON old.publisher = n.publisher AND old.y = n.y - 1 AND old.number = n.number AND old.region = n.region)"""
