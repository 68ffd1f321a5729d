"""Near-copy clusters, inclusion probabilities, splits of hot groups, linear parsing and checked input of the operators."""

import itertools
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import EDGE, PAGE, brute_components, normal, shingles
from wayfold.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, ngram_join, secret_scan, source_mix, toxicity, url_lists

SF = "/root/testdata/sf0.001"


def near_copies(draw, base, copies, most):
    for _ in range(copies):
        words = list(base)
        for at in draw.choice(len(words), draw.integers(1, most), replace=False):
            words[at] = f"x{draw.integers(1 << 30)}"
        yield " ".join(words)


def test_near_duplicates_of_edited_and_assembled_texts(spark):
    """Clusters of near copies with members just below the similarity, and texts made of shared passages."""
    draw = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(2):
        texts += near_copies(draw, draw.choice(vocabulary, 120), 60, 9)
    passages = [" ".join(draw.choice(vocabulary, 40)) for _ in range(9)]
    for _ in range(120):
        texts.append(" ".join(passages[i] for i in draw.choice(9, draw.integers(3, 7), replace=False)))
    expected = brute_components(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(rows).collect()}
    assert [out[i] for i in range(len(texts))] == expected
    assert 60 < len(set(expected)) < len(texts)


def test_parity_maps_bound_the_difference():
    draw = np.random.default_rng(1)
    texts = [" ".join(map(str, draw.integers(0, 50, n))) for n in (1, 30, 200, 260)]
    texts.append(texts[3] + " tail of words")
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["_text"])
    maps = np.array([c.to_numpy() for c in next(ngram_join._maps(iter([batch]))).columns[1:]]).T
    tokens = list(ngram_join.shingle_sets(batch.column("_text")))
    for i, j in itertools.combinations(range(len(texts)), 2):
        differ = sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64))
        assert differ <= len(set(tokens[i].tolist()) ^ set(tokens[j].tolist()))


def test_source_mix_includes_documents_as_planned(spark):
    """Over several seeds a document is taken about as often as its own probability says, and probabilities differ inside a source."""
    sizes = [5, 9, 20, 40, 80, 160] * 40
    rows = spark.createDataFrame([(k, " ".join(["w"] * n), "ab"[k % 240 // 120]) for k, n in enumerate(sizes)], "doc_id long, text string, source string").coalesce(2).cache()
    taken, planned, runs = Counter(), {}, 8
    for seed in range(runs):
        for r in source_mix.mix_sources(rows, seed=seed, large_share=1.0).collect():
            taken[r.doc_id] += r.copies - int(r.target // r.source_size)
            planned[r.doc_id] = (r.inclusion, r.size, r.source)
    for source in "ab":
        by_size = {n: {round(p, 9) for p, size, s in planned.values() if s == source and size == n} for n in set(sizes)}
        assert all(len(p) == 1 for p in by_size.values())
        p = [by_size[n].pop() for n in sorted(by_size)]
        if 0 < p[0] < 1:
            assert p == sorted(p) and len({x for x in p if x < 1}) > 2
            for n in set(sizes):
                ids = [i for i, (_, size, s) in planned.items() if s == source and size == n]
                observed = sum(taken[i] for i in ids) / (runs * len(ids))
                assert observed == pytest.approx(planned[ids[0]][0], abs=0.25), (source, n)
    rows.unpersist()


def test_source_mix_takes_certain_documents_first(spark):
    level = source_mix.sampling_levels(
        spark.createDataFrame([(1, 0, 10, 10.0), (1, 8, 100, 200.0), (1, 20, 1000, 1000 * 32**0.5)], "_group long, _class long, _words long, _measure double"),
        spark.createDataFrame([(1, 1050.0)], "_group long, _goal double"),
    ).first()
    assert level._level == pytest.approx(50 / 210) and level._all == 1110


def test_exact_dedup_splits_many_frequent_digests(spark):
    rows = spark.range(6000).select((F.col("id") % 2000).alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 600).cast("string")).alias("text"))
    kept = exact_dedup.keep_first(rows, counters=1024)
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 600
    winners = exact_dedup._winners(rows.select(F.col("doc_id").alias("_id"), exact_dedup.text_digest().alias("_digest")), None, 1024)
    assert winners.count() > 256


def test_keep_first_of_rows_with_one_id(spark):
    rows = [(1, "a  b"), (1, "a b"), (1, "c"), (2, "c"), (2, "d"), (None, "d"), (None, "e"), (None, "e"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1))
    got = sorted(((str(r.doc_id), normal(r.text)) for r in exact_dedup.keep_first(docs).collect()))
    assert got == [("1", "a b"), ("1", "c"), ("2", "d"), ("3", ""), ("None", "e")]


def test_toxicity_fits_given_grades(spark):
    draw = np.random.default_rng(6)
    level = lambda k: max(0, k % 10 - 6)
    rows = [(k, " ".join([*draw.choice([f"good{i}" for i in range(50)], 30), *(["nasty", "awful", "wretched"][: level(k)])])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.grade(docs, spark.createDataFrame([(k, level(k)) for k in range(600)], "doc_id long, toxic int")).filter("doc_id >= 600").collect()
    means = [np.mean([r.severity for r in out if level(r.doc_id) == g]) for g in range(4)]
    assert means == sorted(means) and means[0] < 0.5 and means[3] > means[1] + 0.3
    assert np.mean([r.rejected == (level(r.doc_id) > 0) for r in out]) > 0.95


def test_toxicity_sample_by_kind_keeps_the_rates(spark):
    draw = np.random.default_rng(8)
    rows = [(k, " ".join([*draw.choice([f"good{i}" for i in range(80)], 30), *(["slurry"] if k % 10 == 0 else [])])) for k in range(1500)]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(1500)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_rows=200)
    assert model.above(np.array([0.0]))[0, 0] < 0.2 and (model.weights > 0).any()


def test_chat_pieces_must_be_whole_and_in_order(spark):
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(6)], "conv_id long, turn long, role string, text string")
    pieces = chat_format.format_chats(rows)
    assert [r.not_located for r in chat_format.digest_chats(pieces).collect()] == [0]
    for wrong in (pieces.filter("position <> 2"), pieces.coalesce(1).sortWithinPartitions(F.desc("position"))):
        with pytest.raises(Exception, match="whole conversations in order"):
            chat_format.digest_chats(wrong.coalesce(1)).collect()

    def shouting(messages):
        return "".join(f"{r}:{t.upper().replace('T', '')};" for r, t in messages)

    told = chat_format.format_chats(rows, shouting).collect()
    assert all(r.loss_start is None for r in told if r.role == "user") and len(told) == 6


def test_html_time_is_linear():
    weights = {"word": 0.5, "linked word": 0.05}
    for piece in ('a{}="v ', "<a ", '<a ="', "<!", "<script", "='", "</", "& <"):
        page = "<article><p>some words here</p><a " + "".join(piece.format(i) for i in range(20_000))
        began = time.time()
        assert html_extract.main_text(page, weights).startswith("some words here")
        assert time.time() - began < 5, piece
    odd = "<article><p class=it's>first part text</p><p>don't lose > this</p></article>"
    assert html_extract.main_text(odd, weights) == "first part text\ndon't lose > this"


def test_html_finds_the_text_without_marks(spark):
    """Weights from marked pages find the same text on other pages whose marks are taken away."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_extract.train(pages.filter("page_id % 2 = 0"))
    rest = [r.html for r in pages.filter("page_id % 2 = 1").collect()]
    bare = [h.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for h in rest]
    same = [html_extract.main_text(a, weights) == html_extract.main_text(b, weights) for a, b in zip(rest, bare)]
    assert sum(same) >= 0.95 * len(same) > 0
    assert "First bold words <here>" in html_extract.main_text(PAGE.replace("{main}", "div"), weights)


def test_url_verdicts_by_salted_join(spark, monkeypatch):
    entries = spark.createDataFrame([("bad.org", "2024-01-05", "block", 1), ("4.5", "2024-01-01", "block", 2)], "domain string, day string, action string, entry_id long").withColumn("day", F.to_date("day"))
    captures = spark.range(200).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 == 0, "http://1.2.4.5/x").otherwise("http://www.bad.org/x").alias("url"), F.to_date(F.lit("2024-01-06")).alias("fetch_day"))
    told = [r.blocked for r in url_lists.judge_captures(captures, entries).orderBy("capture.page_id").collect()]
    assert told == [k % 5 != 0 for k in range(200)]
    monkeypatch.setattr(url_lists, "BROADCAST_VERDICTS", 0)
    assert [r.blocked for r in url_lists.judge_captures(captures, entries).orderBy("capture.page_id").collect()] == told


def test_decontaminate_without_rows_and_with_long_texts(spark):
    benchmark = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler word " * 60_000 + " ".join(f"q{i}" for i in range(20)))], "doc_id long, text string")
    assert [r.item_id for r in decontaminate.find_leaks(docs, benchmark).collect()] == [1]
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == 1


def test_language_rejection_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "zzqx 漢字 qqq xxz", None), (-2, "the", None), (-2, "the", None)], "doc_id long, text string, lang string")
    told = language_id.predict_languages(docs.unionByName(odd), F.col("lang").isNotNull())
    rows = told.filter("doc_id < 0").collect()
    assert len(rows) == 3 and len({(r.lang_pred, r.score) for r in rows if r.doc_id == -2}) == 1
    assert told.filter("accepted").count() >= 0.8 * docs.count()


@pytest.mark.parametrize("part", ["table", "edge", "none"])
def test_pipeline_stages_by_brute_force(spark, part):
    """Exact and near copies by plain Python, on a table, on nulls and odd rows, and on none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if part != "table":
        docs = spark.createDataFrame(EDGE if part == "edge" else [], docs.schema).withColumn("_id", F.lit("x"))
    first = corpus_pipeline.drop_copies(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {}
    for r in docs.collect():
        key = normal(r.text)
        if key not in kept or kept[key] is None or r.doc_id is not None and r.doc_id < kept[key]:
            kept[key] = r.doc_id
    assert sorted(map(str, (r.doc_id for r in first.collect()))) == sorted(map(str, kept.values()))
    left = [r for r in first.collect() if r.doc_id is not None]
    left.sort(key=lambda r: r.doc_id)
    roots = brute_components([r.text for r in left])
    expected = {left[i].doc_id for i in roots} | {r.doc_id for r in left if not shingles(r.text)}
    second = corpus_pipeline.drop_near_copies(spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} - {None} == expected
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_benchmark):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.mix(spark, docs, SF).columns[0] == "doc_id"


def test_source_mix_with_a_source_of_empty_texts(spark):
    rows = [(k, None if k % 2 else "", "empty") for k in range(6)] + [(k, "a b c " * k, "full") for k in range(6, 20)]
    out = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 20 and all(r.taken == 0 and r.source_size == 0 for r in out if r.source == "empty")
    full = [r for r in out if r.source == "full"]
    assert abs(sum(r.taken for r in full) - full[0].target) <= max(r.size for r in full) and all(r.taken <= 2 * r.size for r in full)


def test_clashing_digests_stay_apart(spark):
    """Different sets whose digests share their first half are named by the second, in Spark and in the tasks alike."""
    scanned = spark.createDataFrame([(1, 5, 10, 77), (2, 5, 10, 78), (3, 5, 10, 77), (4, 5, 11, 77), (5, 5, 12, 12)], "_id long, _n long, _first long, _second long")
    nodes, naming = ngram_join._named(scanned)
    assert naming.clashes == {10}
    assert {r._id: r._node for r in nodes.collect()} == {1: 77, 2: 78, 3: 77, 4: 11, 5: 12}
    tokens = np.array([3, 9], np.uint64)
    first, second = ngram_join._halves(tokens)
    assert ngram_join._Naming(frozenset())(tokens) == first and ngram_join._Naming(frozenset([first]))(tokens) == second


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups split into blocks lose no pair."""
    draw = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(900)]
    texts = [" ".join(draw.choice(vocabulary, 60)) for _ in range(40)]
    for _ in range(2):
        texts += near_copies(draw, draw.choice(vocabulary, 90), 30, 8)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 5)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    out = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(rows).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts)


def test_no_coalesce_above_a_scan_of_texts(spark, monkeypatch):
    """Few signatures must not draw the reading of the texts into few tasks."""
    plans = []
    store, cut = ngram_join.store, ngram_join.cut

    def watched(write):
        def run(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df)

        return run

    monkeypatch.setattr(ngram_join, "store", watched(store))
    monkeypatch.setattr(ngram_join, "cut", watched(cut))
    ngram_join.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    scans = [p for p in plans if "documents.parquet" in p]
    assert len(scans) > 5
    for plan in scans:
        depth_of = [(len(line) - len(line.lstrip(" :+-*()0123456789")), line) for line in plan.splitlines()]
        for i, (depth, line) in enumerate(depth_of):
            if "Coalesce" not in line:
                continue
            below = itertools.takewhile(lambda x: x[0] > depth, depth_of[i + 1 :])
            open_lines = []
            for inner, text in below:
                open_lines = [x for x in open_lines if x[0] < inner] + [(inner, text)]
                assert "documents.parquet" not in text or any("Exchange" in t for _, t in open_lines), plan


def test_field_finds_secrets_without_a_base_form(spark):
    """Secrets of other forms are planted into given texts; the field must find nine in ten of them and add nothing to the texts as given."""
    draw = np.random.default_rng(3)
    small, upper, digits = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), list("0123456789")
    some = lambda letters, n: "".join(draw.choice(letters, n))
    forms = [lambda: "ghp_" + some(small + upper + digits, 36), lambda: "sk-" + some(small + upper + digits, 48), lambda: some(small + upper + digits + ["+", "/"], 40), lambda: some(digits + upper[:6], 40)]
    leads = ["auth_key = ", 'client: "', "Bearer ", "", "key: ", "export X="]
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("doc_id % 2 = 1")
    rows, planted = [], {}
    for r in given.filter("doc_id % 50 = 3 and text is not null").collect():
        words = r.text.split(" ")
        at = int(draw.integers(len(words) + 1))
        lead, secret = leads[len(rows) % len(leads)], forms[len(rows) % len(forms)]()
        head = " ".join(words[:at]) + " " + lead
        rows.append((10**6 + r.doc_id, head + secret + ('"' if lead.endswith('"') else "") + " " + " ".join(words[at:])))
        planted[10**6 + r.doc_id] = len(head), len(head) + len(secret)
    out = {r.doc_id: r for r in secret_scan.scan_secrets(given.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    spans = lambda r: [tuple(map(int, s.split(":")[1:])) for s in filter(None, r.spans.split(","))]
    found = sum(any(a <= x + 4 and y <= b for a, b in spans(out[k])) for k, (x, y) in planted.items())
    assert found >= 0.9 * len(planted) > 80
    assert sum(r.n_crf for k, r in out.items() if k < 10**6) <= 1


def test_templates_with_history_are_rendered_whole(spark):
    """Past any number of turns a template sees the whole conversation, and a wrong declaration is found out."""
    numbered = lambda messages: "".join(f"{i}:{role}:{text};" for i, (role, text) in enumerate(messages))
    talk = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(90)]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(rows, numbered).orderBy("position").collect()
    assert "".join(r.piece for r in out) == numbered(talk) and not any(r.rewrites_history or r.not_located for r in out)
    list(chat_format.incremental(iter(talk), turn_local=True))
    whole = [x[1] for x in chat_format.incremental(iter(talk))]
    assert [x[1] for x in chat_format.incremental(iter(talk), turn_local=True)] == whole
    with pytest.raises(ValueError, match="turn-local"):
        list(chat_format.incremental(iter(talk), numbered, turn_local=True))
