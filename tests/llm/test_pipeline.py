import random

import corpus_pipeline
from sparkwarden.llm import decontaminate, jaccard, packing, quality, secrets

from .test_jaccard import brute as brute_components
from .test_packing import check


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    common = "the of and to in is was that for with".split()
    vocab = ["".join(rng.choices("aeinorstlhd", k=rng.randint(4, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    texts = [prose(120) for _ in range(60)]
    texts += [texts[0], texts[1] + " end", texts[2].upper()]
    texts += [prose(40) + " " + items[1][1] + " " + prose(40), items[2][1], prose(60) + " token = " + "0a1b" * 10, "too short", None, "", "same line here\n" * 30, " ".join(w + "###" for w in prose(120).split())]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    ref = quality.references(docs)
    left = {r.doc_id: r for r in quality.judge(docs).collect() if r.kept}
    assert set(range(60)) <= set(left) and not {66, 67, 68, 69, 70} & set(left) and ref
    left = {d: texts[d] for d in left}
    left = {d: t for d, t in left.items() if brute_components(list(left.items()))[d][1] == d}
    assert 60 not in left and 61 not in left
    index = decontaminate.Index(items, decontaminate.Search())
    left = {d: t for d, t in left.items() if not decontaminate.search([t], index)[0]}
    assert 63 not in left and 64 not in left and 65 in left
    known = secrets.automata(secrets.Formats())
    left = {d: secrets.redacted(t, secrets.all_spans(t, known, secrets.Formats())[1]) for d, t in left.items()}
    assert "[SECRET]" in left[65] and "0a1b" not in left[65]
    check(list(left.items()), got, packing.Packing())


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_with_a_shared_doc_id_are_judged_one_by_one(spark):
    rng = random.Random(8)
    common = "the of and to in is was that for with".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeinorstlhd", k=6)) for _ in range(120))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(i, prose(), "en") for i in range(10, 40)]
    rows += [(None, a, "en"), (None, b, "en"), (None, "too short", "en"), (1, c, "en"), (1, "too short", "en"), (1, d, "en"), (1, d, "en"), (2, d + " end", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = quality.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text != "too short")
    left = jaccard.stage(spark, kept, "")
    assert left.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in left.collect() if (r.doc_id or 0) < 10)
    assert got == sorted([("None", a), ("None", b), ("1", c), ("1", d)]) and left.count() == 34


def test_rows_are_accounted_for_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and very long texts and a clashing column: what goes in is kept or has a reason to go."""
    rng = random.Random(21)
    common = "the of and to in is was that for with".split()
    prose = lambda n=120: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeinorstlhd", k=6)) for _ in range(n))
    item, copy, shared = prose(30), prose(), prose()
    clean = [(i, prose()) for i in range(100, 140)] + [(None, prose()), (None, prose()), (7, prose()), (7, prose()), (50, prose(8000))]
    rejected = [(None, "too short"), (7, None), (8, ""), (9, "same line here\n" * 30)]
    repeated = [(1, copy), (2, copy), (2, copy + " end"), (3, "of " + copy)]  # one of them stays
    without_id = [(None, shared), (None, shared)]  # both stay
    leaked = [(None, prose(40) + " " + item + " " + prose(40)), (7, item + " " + prose(60)), (60, prose(60) + " " + item)]
    rows = clean + rejected + repeated + without_id + leaked
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, item_id string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        at = spark.createDataFrame(at.collect(), docs.schema)
        left.append(at.count())
    kept = len(rows) - len(rejected)
    assert left == [kept, kept - 3, kept - 3 - len(leaked), kept - 3 - len(leaked)]
    assert sorted((str(r.doc_id), r.text) for r in at.collect()) == sorted((str(i), t) for i, t in clean + without_id + [(1, copy)])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in packed) == left[-1]
