import corpus
import corpus_pipeline as pipeline
from test_lines import removed_by_hand
from test_simhash import by_hand, groups

from fieldloom.llm import decontam

ITEMS = [(1, " ".join(f"leak{k}" for k in range(14))), (2, None), (3, "")]


def test_stages_against_brute_force(spark, tmp_path):
    rows = list({r[0]: r for r in corpus.documents(count=40)}.values())
    rows += [(500, "Some words before " + ITEMS[0][1].upper() + " and after", "en", "s0", 1), (501, " ".join(f"leak{k}" for k in range(9)) + " other words then", "en", "s0", 1)]
    folder = corpus.saved(spark, tmp_path, rows)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {r[0]: r for r in rows}
    columns = docs.columns
    for at, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns[:5] == columns and (at == 4 or out.columns == columns)
        out.write.parquet(f"{folder}/out_{name}")
        docs = spark.read.parquet(f"{folder}/out_{name}")
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            want = {d for d, t, *_ in kept.values() if t and any(c.isalpha() for c in t)}
            assert set(got) == want
        elif name == "line_dedup":
            texts, gone = removed_by_hand(spark, [tuple(r) for r in kept.values()])
            left = {d: [x for k, x in enumerate(lines) if k not in gone[d]] for d, lines in texts.items()}
            assert {d: r.text for d, r in got.items()} == {d: "\n".join(x) for d, x in left.items() if x}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_dedup":
            label = groups({d: by_hand(r[1], 5) for d, r in kept.items()}, 4)
            assert set(got) == {d for d in kept if label[d] == d}
        elif name == "decontaminate":
            assert set(got) == set(kept) - {500} and 501 in got
        else:
            assert set(got) <= set(kept) and 0 < len(got) < len(kept)
        kept = {d: tuple(r)[:5] for d, r in got.items()}
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == set(kept)


def test_rejects_and_empty_tables(spark, tmp_path):
    folder = corpus.saved(spark, tmp_path, [])
    spark.createDataFrame(ITEMS[:0], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert pipeline.run(spark, folder).count() == 0
    assert decontam.decontaminate(corpus.frame(spark), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == len(corpus.documents())


def test_documents_without_id_stay(spark, tmp_path):
    folder = corpus.saved(spark, tmp_path, [(None, "the and ing tion", "en", "s", 16), (None, "der und ung schen", "de", "s", 17), (1, "the and ing tion", "en", "s", 16)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pipeline.near_dedup(spark, docs, folder).count() == 3
    assert pipeline.line_dedup(spark, docs, folder).where("doc_id is null").count() == 2


def test_idle_workers_give_memory_back(monkeypatch):
    from fieldloom.llm import arrays

    done = []
    monkeypatch.setattr(arrays.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(lambda _: done.append("trimmed"))}))
    for batch in arrays.tidy(lambda batches: (b + 1 for b in batches))([1, 2]):
        done.append(batch)
    assert done == [2, 3, "trimmed"]
