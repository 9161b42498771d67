"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Known forms (assignments, access keys, hexadecimal runs) are found by pattern.
Besides them every token of ``[A-Za-z0-9+/_=-]`` with 20 or more characters that
touches no such span is a candidate. Its encoding is inferred from its
characters, and three statistics are taken: chi-squared for uniform use of the
alphabet, runs, and serial correlation of neighbours. Each is read twice:

* against "random in this alphabet": a candidate passes if none of the three
  p-values, times three, is under ``alpha`` (runs about the alphabet's middle);
* against "ordinary text", which repeats characters more, changes their class less and
  puts like characters side by side: the three standardised distances (runs of
  classes here) add up to one p-value by Stouffer's rule.

The combined p-values of candidates of similar length share the
Benjamini-Hochberg control of false discoveries at level ``q`` over the whole
corpus, so short tokens, which text produces by chance, need stronger evidence
where they are many.

Defined results: null text is empty; repeated rows have equal results, and each
counts in the control; an empty table gives an empty one; spans are code points,
end exclusive; a text with n matches costs n times the square root of n besides
its length; columns of the input stay, but those named ``base``, ``candidates``
or ``spans`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import durable

#: The known forms, in the order of their kinds: name, pattern, group and least length of it.
FORMS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings from narrow to wide: name, alphabet in order.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("hexupper", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36upper", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("any", "+-/" + _DIGITS + "=" + _UPPER + "_" + _LOWER),
)
#: Under ordinary text: chance that two characters agree, that the class changes between neighbours; serial correlation.
TEXT_AGREE, TEXT_CHANGE, TEXT_SERIAL = 0.065, 0.3, 0.1
#: Classes of length for the control of false discoveries: up to and with.
STRATA = (27, 39, 63)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(rows: Column, zero: Column, step, out, kind: str) -> Column:
    """``out(state, row)`` of every row, with the state that ``step`` makes of all rows before it.

    Rows go in blocks of the square root of their number: arrays that grow by one element at a time are copied each time.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def block(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), lambda a, m: F.struct(step(a["state"], m).alias("state"), F.concat(a["out"], F.array(out(a["state"], m))).alias("out")))
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocks(all_rows: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_rows))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.size(all_rows), size), lambda at: F.slice(all_rows, at, size))

    return F.flatten(F.aggregate(let(rows, blocks), F.struct(zero.alias("state"), nothing.alias("out")), block)["out"])


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start,end,part>>`` of a pattern's leftmost matches that don't overlap."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = lambda of: F.transform(of, lambda x: F.length(x))
    rows = let(F.struct(pieces.alias("gap"), whole.alias("whole"), part.alias("part")), lambda r: F.arrays_zip(F.slice(sizes(r["gap"]), 1, F.size(r["whole"])).alias("gap"), sizes(r["whole"]).alias("whole"), r["part"].alias("part")))
    span = lambda at, m: F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + m["whole"]).alias("end"), m["part"].alias("part"))
    kind = "struct<start:int,end:int,part:string>"
    return F.when(text.rlike(pattern), scanned(rows, F.lit(0), lambda at, m: at + m["gap"] + m["whole"], span, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def untouched(tokens: Column, base: Column) -> Column:
    """``tokens`` (disjoint) that overlap no span of ``base``: one pass over the starts of spans and the ends of tokens, with the furthest end of a span so far."""
    kind = "struct<start:int,end:int,part:string>"
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("kind"), b["end"].alias("other"), F.lit(None).cast("string").alias("part")))
    ends = F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("kind"), t["start"].alias("other"), t["part"].alias("part")))
    free = lambda far, e: F.when((e["kind"] == 0) & (far <= e["other"]), F.struct(e["other"].alias("start"), e["at"].alias("end"), e["part"].alias("part")))
    left = scanned(F.array_sort(F.concat(starts, ends)), F.lit(0), lambda far, e: F.when(e["kind"] == 1, F.greatest(far, e["other"])).otherwise(far), free, kind)
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(F.array_compact(left))


def known(text: Column, kind: int) -> Column:
    """Spans of a known form whose part is long enough."""
    _, pattern, group, least = FORMS[kind]
    long = F.filter(found(text, pattern, group), lambda m: F.length(m["part"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal: a series in the tail, a rational form (error under 1e-7) elsewhere."""
    x = F.abs(z)
    y = F.greatest(x, F.lit(5.0))
    t = 1 / (1 + 0.2316419 * x)
    density = F.exp(-x * x / 2) * 0.3989422804014327
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / y * (1 - 1 / (y * y) + 3 / (y * y * y * y) - 15 / (y * y * y * y * y * y))
    tail = F.when(x > 5, far).otherwise(near)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """Name of the first encoding whose alphabet holds every character."""
    out = F.lit("any")
    for name, alphabet in reversed(ENCODINGS[:-1]):
        # Padding may end a token of base 32 or 64.
        out = F.when(F.length(F.translate(F.rtrim(token, F.lit("=")) if name.startswith(("base32", "base64")) else token, alphabet, "")) == 0, name).otherwise(out)
    return out


def battery(token: Column, name: Column) -> Column:
    """Test results of a token of an encoding: chi2_p, runs_p, serial_p, text_p."""
    size, place = F.lit(float(len(ENCODINGS[-1][1]))), F.lit(ENCODINGS[-1][1])
    for n, alphabet in ENCODINGS[:-1]:
        size = F.when(name == n, float(len(alphabet))).otherwise(size)
        place = F.when(name == n, F.lit(alphabet)).otherwise(place)
    body = F.rtrim(token, F.lit("="))
    base = F.struct(size.alias("k"), place.alias("alphabet"), F.length(body).cast("double").alias("n"), F.filter(F.split(body, ""), lambda c: c != "").alias("chars"), body.alias("body"))
    with_places = lambda s: F.struct(*(s[c].alias(c) for c in ("k", "n", "chars", "body")), F.transform(s["chars"], lambda c: F.instr(s["alphabet"], c).cast("double") - 1).alias("at"))

    def tests(s: Column) -> Column:
        n, k, at = s["n"], s["k"], s["at"]
        squares = F.aggregate(F.array_distinct(s["chars"]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s["body"], c, F.lit(""))), F.lit(2.0)))
        chi2 = k * squares / n - n
        cube = (F.pow(F.greatest(chi2, F.lit(1e-9)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        index = F.sequence(F.lit(1), (n - 1).cast("int"))
        high = F.aggregate(at, F.lit(0.0), lambda a, v: a + (v >= k / 2).cast("double"))
        low = n - high
        runs = F.aggregate(index, F.lit(1.0), lambda a, i: a + ((F.get(at, i) >= k / 2) != (F.get(at, i - 1) >= k / 2)).cast("double"))
        mean_runs = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
        middle = F.aggregate(at, F.lit(0.0), lambda a, v: a + v) / n
        power = F.aggregate(at, F.lit(0.0), lambda a, v: a + (v - middle) * (v - middle))
        lagged = F.aggregate(index, F.lit(0.0), lambda a, i: a + (F.get(at, i) - middle) * (F.get(at, i - 1) - middle))
        serial = (lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        # Chi-squared again, as the number of pairs of characters that agree.
        pairs, agree = n * (n - 1) / 2, (squares - n) / 2
        fewer = (pairs * TEXT_AGREE - agree) / F.sqrt(pairs * TEXT_AGREE * (1 - TEXT_AGREE))
        kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)
        changes = F.aggregate(index, F.lit(0.0), lambda a, i: a + (kind(F.get(s["chars"], i)) != kind(F.get(s["chars"], i - 1))).cast("double"))
        more = (changes - (n - 1) * TEXT_CHANGE) / F.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE))
        apart = (TEXT_SERIAL - lagged / F.greatest(power, F.lit(1e-9))) * F.sqrt(n)
        both_sides = lambda z: F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))
        values = F.struct(
            upper_tail(cube).alias("chi2_p"),
            F.when((high == 0) | (low == 0), 0.0).otherwise(both_sides((runs - mean_runs) / spread)).alias("runs_p"),
            both_sides(serial).alias("serial_p"),
            upper_tail((fewer + more + apart) / 1.7320508075688772).alias("text_p"),
        )
        # Padding alone is no secret.
        return F.when(n >= 4, values).otherwise(F.struct(*(F.lit(v).alias(c) for c, v in (("chi2_p", 0.0), ("runs_p", 0.0), ("serial_p", 0.0), ("text_p", 1.0)))))

    # transform over one element: each intermediate struct is computed once.
    staged = F.transform(F.array(base), with_places)
    return F.get(F.transform(staged, tests), F.lit(0))


def stratum(length: Column) -> Column:
    out = F.lit(len(STRATA))
    for k, most in reversed(list(enumerate(STRATA))):
        out = F.when(length <= most, k).otherwise(out)
    return out


#: Steps of the p-value's decimal logarithm, and the last of them.
STEP, LAST = 0.02, 3000


def scan(docs: DataFrame, text_col: str = "text", alpha: float = 0.001, q: float = 0.001) -> DataFrame:
    """``docs`` without the text, with ``base`` and ``spans``: ordered ``array<struct<start,kind,end>>`` (kind: place in FORMS, 3 for random)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [known(text, k) for k in range(len(FORMS))]
    out = docs.withColumns({"base": F.array_sort(F.concat(*base)), "candidates": found(text, CANDIDATE)}).drop(text_col)
    tokens = untouched(F.col("candidates"), F.col("base"))

    def judged(m: Column) -> Column:
        name = encoding(m["part"])
        result = battery(m["part"], name)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), name.alias("encoding"), result.alias("result"))

    out = out.withColumn("candidates", F.transform(tokens, judged))
    result = lambda c: c["result"]
    step = lambda c: F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(result(c)["text_p"], F.lit(1e-300))) / STEP)).cast("int")
    passed = lambda c: 3 * F.least(result(c)["chi2_p"], result(c)["runs_p"], result(c)["serial_p"]) >= alpha
    out = out.withColumn("candidates", F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), result(c).alias("result"), stratum(c["end"] - c["start"]).alias("stratum"), step(c).alias("step"), passed(c).alias("passed"))))
    out = durable.keep(out)
    # One row for each stratum and step: a few thousand at most, whatever the corpus.
    counts = out.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.step").count().collect()
    cuts = {}
    for s in {r.stratum for r in counts}:
        own = sorted(((r.step, r["count"]) for r in counts if r.stratum == s), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for at, n in own:
            seen += n
            if 10 ** (-at * STEP) <= q * seen / total:
                cuts[s] = at
    cut = F.create_map(*(F.lit(x) for s in range(len(STRATA) + 1) for x in (s, cuts.get(s, LAST + 1))))
    kept = F.filter("candidates", lambda c: c["passed"] & (c["step"] >= cut[c["stratum"]]))
    random = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(len(FORMS)).alias("kind"), c["end"].alias("end")))
    return out.withColumn("spans", F.array_sort(F.concat("base", random)))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*(F.lit(n) for n, *_ in FORMS), F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the spans of every document."""
    found_in = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found_in.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
