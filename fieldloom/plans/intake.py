"""Queries of the sources: documents, workbooks, the weather service, files in order."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contracts, features, history, reports, tables, words
from ..sources import files, pages, shared, sinks, versions, weather, workbook
from .catalog import _JOINED, _MONTH, _seasons, query
from .panel import DAILY_SQL, HISTORY_SQL, SHIFT, daily, moved, table
from .panel import history as harvest
from .reportpages import CELLS, HEADS, SIZE, TITLE, TOTALS_SQL, report_documents
from .sheets import write_workbooks

_DOTTED = "replace(format('{{:,}}', {}), ',', '.')"
_CELL_X = [f"CASE place {' '.join(f'WHEN {k} THEN {c[i]}' for k, c in enumerate(CELLS))} END" for i in range(3)]
_PAIR = lambda y: f"({y}) || '/' || ({y} + 1)"
_WORDS = f"""{TOTALS_SQL}, h AS (SELECT DISTINCT doc, y FROM b),
w AS (SELECT doc, 1 AS page, {_DOTTED.format("before")} AS text, {_CELL_X[0]} AS x, 100 + 14 * number AS top FROM b
  UNION ALL SELECT doc, 1, {_DOTTED.format("total")}, {_CELL_X[1]}, 100 + 14 * number FROM b
  UNION ALL SELECT doc, 1, (tenths // 10) || ',' || (tenths % 10) || '%', {_CELL_X[2]}, 100 + 14 * number FROM b
  UNION ALL SELECT doc, 1, strftime(period_end_date, '%d/%m'), 36, 100 + 14 * number FROM b WHERE region = 'sao_paulo'
  {" ".join(f"UNION ALL SELECT doc, 1, '{t}', {x}, {top} FROM h" for t, x, top in (*((t, 30 + 60 * k, 20) for k, t in enumerate(TITLE.split(" "))), *HEADS))}
  {" ".join(f"UNION ALL SELECT doc, 1, {_PAIR(f'y - 1 + {k}')}, {c[k]}, {78 + k} FROM h" for c in CELLS for k in (0, 1))}
  UNION ALL SELECT doc, 0, 'Relatório', 30, 40 FROM h UNION ALL SELECT doc, 0, '(final)', 90, 40 FROM h UNION ALL SELECT doc, 0, {_PAIR("y")}, 150, 41 FROM h),
l AS (SELECT *, CASE top WHEN 79 THEN 78 WHEN 41 THEN 40 ELSE top END AS line FROM w)"""


@query(f"""WITH {_WORDS} SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY line, x) - 1 AS word_idx, text, x::DOUBLE AS x0, round((x + length(text) * {SIZE * 0.6})::DOUBLE, 3) AS x1, top::DOUBLE AS top FROM l""")
def report_pdf_words(spark, sf_dir):
    """Positioned words of the documents that are made of all orders."""
    found = pages.page_words(report_documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 3) for c in ("x0", "x1", "top")}).withColumns({c: F.col(c).cast("bigint") for c in ("page", "word_idx")})


@query(f"""WITH {_WORDS}, n AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x) AS text FROM l GROUP BY ALL) SELECT doc, page, string_agg(text, chr(10) ORDER BY line) AS text FROM n GROUP BY ALL""")
def report_pdf_texts(spark, sf_dir):
    return pages.page_texts(report_documents(spark, sf_dir))


_LABEL = "lpad((({0}) % 100)::VARCHAR, 2, '0') || '-' || lpad((({0} + 1) % 100)::VARCHAR, 2, '0')"


@query(f"""WITH {TOTALS_SQL}, v AS (SELECT doc, y - 1 AS y, number, before AS total, region, tenths FROM b UNION ALL SELECT doc, y, number, total, region, tenths FROM b)
SELECT v.doc, {_LABEL.format("v.y")} AS season, e.period_end_date, region, total - coalesce(lag(total) OVER (PARTITION BY v.doc, v.y, region ORDER BY v.number), 0) AS crush_tonnes, (tenths / 10)::DOUBLE AS variation_percent
FROM v JOIN e ON e.y = v.y AND e.number = v.number""")
def report_pdf_history(spark, sf_dir):
    """Documents to words, words to tables, tables to tonnes by period: one plan."""
    found = pages.words_of(pages.characters(report_documents(spark, sf_dir)))
    return reports.normalized_reports(words.titled_tables(found, TITLE))


@query(f"SELECT o_orderkey::VARCHAR AS order_key, (o_orderdate + INTERVAL {SHIFT} YEAR)::DATE AS day, o_totalprice::DOUBLE AS price, o_orderpriority AS priority, year(o_orderdate) + {SHIFT} || '.xlsx' AS file FROM orders")
def workbook_rows(spark, sf_dir):
    """All orders as a workbook for each year, below three other rows, read by ranges of rows and without the column of notes."""
    day = moved("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(F.year(day).alias("year"), F.col("o_orderkey").alias("ORDER & KEY"), day.alias("DAY"), F.lit("not wanted").alias("NOTE"), F.col("o_totalprice").cast("double").alias("PRICE"), F.col("o_orderpriority").alias("PRIORITY"))
    with shared.scratch(spark) as folder:
        write_workbooks(orders, "year", ["ORDER & KEY"], "orders", folder, preamble=3, others={"cover": [["nothing"]]})
        read = workbook.read_sheet(spark, folder, "orders", header_row=3, columns=["ORDER & KEY", "DAY", "PRICE", "PRIORITY"], rows_per_partition=1000)
        typed = read.select(F.col("ORDER & KEY").alias("order_key"), F.col("DAY").cast("date").alias("day"), F.col("PRICE").cast("double").alias("price"), F.col("PRIORITY").alias("priority"), F.element_at(F.split("_file", "/"), -1).alias("file"))
        return shared.keep(typed)


@query(f"SELECT season, period_end_date, region, crush_tonnes::DOUBLE AS crush_tonnes FROM ({HISTORY_SQL}) WHERE region <> 'centre_south'")
def workbook_crush(spark, sf_dir):
    """The harvest history as a workbook for each season, sheet TB_02 with its header in the ninth row, to the checked period table."""
    region = F.when(F.col("region") == "sao_paulo", " SÃO PAULO").otherwise("DEMAIS ESTADOS ")
    rows = harvest(spark, sf_dir).where("region <> 'centre_south'").select("season", F.concat(F.lit(" "), F.col("season")).alias("SAFRA"), F.col("period_end_date").alias("QUINZENA"), region.alias("REGIÃO"), F.col("crush_tonnes").alias("MOAGEM"))
    with shared.scratch(spark) as folder:
        write_workbooks(rows, "season", ["QUINZENA", "REGIÃO"], "TB_02", folder, preamble=8)
        raw = workbook.read_sheet(spark, folder, "TB_02", header_row=8, rows_per_partition=16)
        made = shared.keep(tables.period_table(raw, tables.CRUSH_COLUMNS))
    return tables.check_period_table(made, "crush_tonnes")


@query(f"SELECT o_custkey, max_by(o_orderkey, (year(o_orderdate) + {SHIFT}) * 10000000000 + o_orderkey) AS o_orderkey, max(year(o_orderdate) + {SHIFT})::INT AS year FROM orders GROUP BY 1")
def keep_last_in_files(spark, sf_dir):
    """All orders in files by year, of unequal size and sorted by key; of each customer the last row in the order of files and rows."""
    orders = table(spark, sf_dir, "orders").select(F.year(moved("o_orderdate")).alias("year"), "o_custkey", "o_orderkey")
    with shared.scratch(spark) as folder:
        years = sinks.save_by(orders, folder, "year", "o_orderkey")
        read = files.read_csv(spark, [f"{folder}/{y}.csv" for y in years], "o_custkey bigint, o_orderkey bigint", sequence="place")
        last = history.keep_last(read, ["o_custkey"], "place")
        year = F.get(F.array(*(F.lit(int(y)) for y in years)), F.col("place.listed"))
        return shared.keep(last.select("o_custkey", "o_orderkey", year.alias("year")))


_KNOWN = f"SELECT * FROM ({HISTORY_SQL}) WHERE region <> 'centre_south'"


@query(f"""WITH h AS ({_KNOWN}), o AS (SELECT * FROM h WHERE period_end_date < DATE '2009-01-01'), n AS (SELECT * FROM h WHERE period_end_date >= DATE '2009-01-01')
SELECT 'first' AS version, *, NULL AS previous FROM o UNION ALL SELECT 'second', *, 'first' FROM o UNION ALL SELECT 'second', *, 'first' FROM n UNION ALL SELECT 'restored', *, NULL FROM o""")
def versioned_history(spark, sf_dir):
    """A version, one that fails while it is written, one with too few rows, one that adds later reports, and the first one restored."""
    every = harvest(spark, sf_dir).where("region <> 'centre_south'")
    old, new = every.where("period_end_date < DATE '2009-01-01'"), every.where("period_end_date >= DATE '2009-01-01'")
    broken = F.when(F.col("crush_tonnes") % 7 == 3, F.raise_error(F.lit("a task fails")).cast("bigint")).otherwise(F.col("crush_tonnes"))
    with shared.scratch(spark) as folder:
        store = versions.Versions(spark, folder)
        store.write(old, name="first")
        for name, rows, expected in (("broken", every.withColumn("crush_tonnes", broken), None), ("short", new, every.count())):
            try:
                store.append(rows, expected, name=name)
            except Exception as failed:
                if "a task fails" not in str(failed) and "verification failed" not in str(failed):
                    raise
        store.append(new, name="second")
        assert store.names() == ["first", "second"] and store.damaged().isEmpty()
        told = store.history().select("version", "previous")
        both = [store.read(name).withColumn("version", F.lit(name)) for name in ("first", "second")]
        store.point_to("first")
        restored = store.read().withColumn("version", F.lit("restored"))
        made = both[0].unionByName(both[1]).unionByName(restored).join(F.broadcast(told), "version", "left")
        return shared.keep(made.select("version", *history.COLUMNS, "previous"))


def _service(folder: str):
    """A weather service whose answers are files: one place in seven always fails, one in five is busy twice."""
    asked: Counter = Counter()

    def answer(params: dict) -> tuple[int, str]:
        system, path = shared.located(folder)
        code = round(params["latitude"] / 1.5)
        asked[code] += 1
        if code % 7 == 3:
            return 503, ""
        if code % 5 == 1 and asked[code] < 3:
            return 429, ""
        name = f"{path}/{code}-{params['start'][:4]}.json"
        if not system.get_file_info(name).is_file:
            return 404, ""
        with system.open_input_stream(name) as file:
            body = json.loads(file.read())
        every = body["properties"]["parameter"]
        for p in every:
            every[p] = {d: v for d, v in every[p].items() if params["start"] <= d <= params["end"]}
        return 200, json.dumps(body)

    return answer


_DAYS = f"d AS (SELECT * FROM ({DAILY_SQL}) WHERE year BETWEEN 2003 AND 2005)"


@query(f"""WITH {_DAYS}, s AS (SELECT DISTINCT ibge_code, municipality FROM ({DAILY_SQL})), w AS (SELECT * FROM d WHERE date >= DATE '2003-06-01' AND date < DATE '2005-03-16' AND ibge_code % 7 <> 3)
SELECT date AS Date, ibge_code, municipality, PRECTOTCORR, T2M, RH2M, NULL AS error FROM w
UNION ALL SELECT NULL, ibge_code, municipality, NULL, NULL, NULL, CASE WHEN ibge_code % 7 = 3 THEN 'The request failed after 3 attempts: status 503' ELSE 'The request failed after 3 attempts: status 404' END
FROM s, (VALUES (2003), (2004), (2005)) AS y(y) WHERE ibge_code % 7 = 3 OR NOT EXISTS (SELECT 1 FROM d WHERE d.ibge_code = s.ibge_code AND d.year = y.y)""")
def weather_service(spark, sf_dir):
    """The daily panel asked of a service by station and year, within pushed-down dates; failed requests are rows of the second output."""
    days = daily(spark, sf_dir)
    day = F.date_format("date", "yyyyMMdd")
    own = days.where("year between 2003 and 2005").groupBy("ibge_code", "year").agg(*(F.map_from_entries(F.collect_list(F.struct(day, c))).alias(c) for c in weather.PARAMETERS))
    body = F.to_json(F.struct(F.struct(F.struct(*weather.PARAMETERS).alias("parameter")).alias("properties")))
    answers = own.select(F.concat("ibge_code", F.lit("-"), "year", F.lit(".json")).alias("name"), body.cast("binary").alias("content"))
    stations = days.select(*weather.STATION).distinct()
    with shared.scratch(spark) as folder:
        shared.write_files(answers, folder)
        rows, failed = weather.download(stations, [(f"{y}0101", f"{y}1231") for y in (2003, 2004, 2005)], _service(folder), where="Date >= DATE '2003-06-01' AND Date < DATE '2005-03-16'", tries=3, wait=0)
    names = ("Date", "ibge_code", "municipality", *weather.PARAMETERS, "error")
    return rows.withColumn("error", F.lit(None).cast("string")).select(*names).unionByName(failed, allowMissingColumns=True).select(*names)


@query(f"""SELECT n_name AS municipality, (year(o_orderdate) + {SHIFT})::VARCHAR AS year, floor(sum(o_totalprice::DECIMAL(12,2)))::BIGINT AS tonnes
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA' GROUP BY 1, 2""")
def municipal_matrix(spark, sf_dir):
    """Yearly totals of every nation as a matrix of municipalities and years below three other lines; those of one state, back to rows."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("n_name", F.when(F.col("r_name") == "AMERICA", " (SP)").otherwise(" (MG)"))
    wide = placed.withColumn("year", F.year(moved("o_orderdate"))).groupBy(name.alias("place")).pivot("year").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("bigint"))
    years = wide.columns[1:]
    line = F.concat_ws(",", F.concat(F.lit('"'), F.col("place"), F.lit('"')), *(F.coalesce(F.col(y).cast("string"), F.lit("")) for y in years))
    head = ["Produção", "Fonte: tabelas", "toneladas", ",".join(["Lugar", *(f'"{y}"' for y in years)]), ",".join(["Cana", *years])]
    # One line for each nation.
    text = wide.agg(F.concat_ws("\n", F.array(*(F.lit(h) for h in head)), F.sort_array(F.collect_list(line))).alias("text"))
    with shared.scratch(spark) as folder:
        shared.write_files(text.select(F.lit("matrix.csv").alias("name"), F.col("text").cast("binary").alias("content")), folder)
        raw, found = files.municipal_matrix(spark, f"{folder}/matrix.csv")
        own = tables.municipal_production(raw, found)
        return shared.keep(own.unpivot("municipality", found, "year", "tonnes").where("tonnes is not null").withColumn("tonnes", F.col("tonnes").cast("bigint")))


_BUILT = _MONTH.replace(DAILY_SQL, f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ibge_code, year, month) AS n FROM ({DAILY_SQL})) WHERE n > 1")


@query(f"{_BUILT} SELECT * FROM w")
def monthly_build(spark, sf_dir):
    """Daily weather in files of text by period, each built to checked months, then all merged and checked again."""
    several = F.count(F.lit(1)).over(Window.partitionBy("ibge_code", "year", "month"))
    days = daily(spark, sf_dir).withColumn("n", several).where("n > 1")
    days = days.select(F.when(F.col("year") < 2006, "early").otherwise("late").alias("period"), F.col("date").alias("Date"), *features.DAILY_COLUMNS[1:])
    with shared.scratch(spark) as folder:
        periods = sinks.save_by(days, folder, "period")
        built = [features.build_monthly(files.daily_weather(spark, f"{folder}/{p}.csv")) for p in periods]
        return shared.keep(features.merge_monthly(built))


@query(f"{_JOINED} SELECT state, harvest_season, 2000 + substr(harvest_season, 1, 2)::INT AS season_start_year, growing_season_start, latest_report_date, cumulative_crush_tonnes, municipality_count, round(total_growing_season_rainfall, 6) AS rainfall FROM wh WHERE has_complete_growing_season")
def comparison_file(spark, sf_dir):
    """The joined dataset as text, its flag in mixed case, read with its checks: complete seasons."""
    seasons = _seasons(spark, sf_dir)
    flag = F.when(F.col("has_complete_growing_season"), F.lit(" TRUE")).otherwise(F.lit("False"))
    with shared.scratch(spark) as folder:
        seasons.withColumn("has_complete_growing_season", flag).write.option("header", True).csv(f"{folder}/joined")
        df = files.comparison(spark, f"{folder}/joined", least=1)
        names = ("state", "harvest_season", "season_start_year", "growing_season_start", "latest_report_date", "cumulative_crush_tonnes", "municipality_count")
        return shared.keep(df.select(*names, F.round("total_growing_season_rainfall", 6).alias("rainfall")))


@query(f"""WITH h AS ({_KNOWN}) SELECT 'lost' AS what, season, period_end_date, region, crush_tonnes FROM h WHERE crush_tonnes % 5 = 0 UNION ALL SELECT 'changed', * FROM h WHERE crush_tonnes % 5 = 1
UNION ALL SELECT 'overlap', * FROM h WHERE period_end_date BETWEEN DATE '2005-01-01' AND DATE '2005-12-31'""")
def history_preserved(spark, sf_dir):
    """Rows that a merge lost, rows that it changed, and the overlap of two parts of the history."""
    known = harvest(spark, sf_dir).where("region <> 'centre_south'").select(*history.COLUMNS)
    fifth = F.col("crush_tonnes") % 5
    changed = known.withColumn("crush_tonnes", F.when(fifth == 1, F.col("crush_tonnes") + 1).otherwise(F.col("crush_tonnes")))
    lost = history.lost_or_changed(known, known.where(fifth != 0)).withColumn("what", F.lit("lost"))
    other = history.lost_or_changed(known, changed).withColumn("what", F.lit("changed"))
    early, late = known.where("period_end_date <= DATE '2005-12-31'"), known.where("period_end_date >= DATE '2005-01-01'")
    both = contracts.checked_join(early, late.select(*history.KEY), list(history.KEY)).withColumn("what", F.lit("overlap"))
    return lost.unionByName(other).unionByName(both)
