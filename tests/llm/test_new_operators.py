"""Whitening, exact top products and fill-in-middle against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import html, infill, licenses, line_dedup, mixing, products, quality, whitening

FIELDS = "vec_id long, embedding array<float>, whitened string, rank string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "w", "r", 0) for i, v in rows], FIELDS).repartition(3)


def lengths(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)) * np.exp(spread * rng.standard_normal((n, 1)))


def top(rows, asks, k):
    """(query, rank) -> (vec_id, score); of equal rows one counts."""
    kept = {(i, tuple(int(np.floor(64 * float(np.float32(c)))) for c in v)) for i, v in rows}
    found = {}
    for q, x in kept:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in kept if i != q)[:k]
            found.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)})
    return found


@pytest.mark.parametrize("spread, copies", [(0.0, 0), (0.8, 0), (0.3, 150)])
def test_top_products_equal_brute_force(spark, monkeypatch, spread, copies):
    """Small buckets, runs and parts; unequal lengths; a third of the rows the same vector."""
    for name, size in (("BUCKET", 32), ("RUN", 2), ("QUERIES", 16), ("BLOCK", 8), ("SPANS", 3)):
        monkeypatch.setattr(products, name, size)
    rows = list(enumerate(lengths(1, 450, 6, spread)))
    rows += [(1000 + i, rows[7][1]) for i in range(copies)] + rows[:40]
    got = products.top_products(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=7).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == top(rows, lambda q: q % 5 == 0, 7)


def test_top_products_on_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, [1, 2, -3]), (20, [0, 0, 0]), (3, [1, 2, -3]), (2, [1, 2, -3]), (4, [-1, 0, 0.01]), (5, [3e5, 1, 1])]
    bad = [(40, None), (60, []), (6, [1, None, 1]), (7, [inf, 1, 1]), (8, [nan, 1, 1]), (None, [9, 9, 9]), (9, [1, 1]), (80, [1e30, 1, 1])]
    got = products.top_products(vectors(spark, good + bad + good), F.col("vec_id") % 20 == 0, k=20).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == top(good, lambda q: q % 20 == 0, 20)
    assert products.top_products(vectors(spark, good).where("false"), F.lit(True)).count() == 0
    assert products.top_products(vectors(spark, good), F.lit(False)).count() == 0


def test_coordinates_prune_and_lose_nothing():
    """Clustered vectors: the intervals leave few to verify, and the best ones among them."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) / 4
    points = np.floor(64 * (centres[rng.integers(0, 40, 3000)] * 8 + 0.3 * rng.standard_normal((3000, 16))))
    norms, ids = np.linalg.norm(points, axis=1), np.arange(3000)
    asks = points[:50]
    scores = (asks @ points.T).astype(np.int64)
    scores[np.arange(50), np.arange(50)] = -(1 << 62)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    floor = np.take_along_axis(scores, order, 1)[:, 4]
    best = products.Best(ids[:50], floor, 5)
    done = products.search(products.Bucket(ids, points, norms), asks, norms[:50], best, True)
    assert (best.vec_id == order).all()
    assert 0 < done["coordinate"] + done["length"] < 0.2 * scores.size and done["coordinate"] > 0


def test_lengths_rule_out_whole_buckets():
    points = np.floor(64 * lengths(3, 400, 8, 0.0))
    norms, ids = np.linalg.norm(points, axis=1), np.arange(400)
    best = products.Best(np.array([-1]), np.array([10 * int(norms.max() ** 2)]), 5)
    assert products.search(products.Bucket(ids, points, norms), points[:1], norms[:1], best, True) == {"length": 0, "coordinate": 0}


def test_whitening_equals_a_plain_one(spark, monkeypatch):
    """Several blocks, repeated vectors, and rows that take no part."""
    monkeypatch.setattr(whitening, "BLOCK_CELLS", 5 * 40)
    rng = np.random.default_rng(4)
    points = rng.standard_normal((230, 5)) @ rng.standard_normal((5, 5))
    good = list(enumerate(points)) + [(500 + i, points[3]) for i in range(200)] + [(0, points[0]), (None, points[1])]
    bad = [(900, None), (901, []), (902, [1, None, 1, 1, 1]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1, 1])]
    got = whitening.whiten(vectors(spark, good + bad), components=4).toPandas()
    x = np.floor(256 * np.float32(points).astype(float))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    assert len(got) == 4 * len(good) and set(got["n"]) == {n}
    for j, (value, axis) in enumerate(zip(values[order], axes[:, order].T, strict=True)):
        part = got[got["component"] == j + 1].dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id").loc[range(230)]
        wanted = (x - fit.mean(0)) @ axis / np.sqrt(value)
        sign = np.sign(wanted @ part["whitened"].to_numpy())
        assert np.abs(sign * part["whitened"].to_numpy() - wanted).max() < 1e-9
        assert np.allclose(part["explained"], value / np.trace(cov), rtol=1e-9)
        assert (part["deviation"].to_numpy() == ((n * x - total) ** 2).sum(1)).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    hot = got[(got["vec_id"] >= 500) & (got["component"] == 2)]
    assert len(hot) == 200 and hot["whitened"].nunique() == 1


def test_whitening_of_flat_and_empty_tables(spark):
    line = [(i, [i, 2 * i, 1]) for i in range(20)]
    got = whitening.whiten(vectors(spark, line)).toPandas()
    assert sorted(got["component"].unique()) == [1, 2, 3]
    assert got[got["component"] == 1]["whitened"].notna().all() and got[got["component"] > 1]["whitened"].isna().all()
    same = whitening.whiten(vectors(spark, [(1, [4, 4])] * 3 + [(2, [1e15, 1])])).where("vec_id = 1").toPandas()
    assert len(same) == 6 and same["deviation"].isna().all()  # no long holds 10^34
    one = whitening.whiten(vectors(spark, [(1, [4, 4])])).toPandas()
    assert one["whitened"].isna().all() and set(one["deviation"]) == {0} and one["identity_error"].isna().all()
    assert whitening.whiten(vectors(spark, line).where("false")).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0


def plain_fim(doc_id, text, percent, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 10)])
def test_fill_in_middle(spark, percent, spm):
    rng = random.Random(6)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "x <S> y\nz", "<\nP>\n<", "é漢🎉\n\r\nß🎉", "end <", "\n" * 5000, "long line " * 40_000]
    texts += ["\n".join("w🎉" * rng.randint(0, rng.choice([2, 60])) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "a\nb\nc"), (5, texts[20]), (20, texts[20])]
    df = spark.createDataFrame([(i, t, 3, "f") for i, t in rows], "doc_id long, text string, n int, form string")
    found = infill.fill_in_middle(df, 7, percent, spm).withColumn("back", infill.rebuilt(F.col("output"), F.col("form")))
    got = found.collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str(plain_fim(i, t, percent, spm)) for i, t in rows)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert infill.fill_in_middle(df.where("false")).count() == 0


def test_rank_index_is_exact_and_bounded():
    rng = random.Random(8)
    for _ in range(200):
        steps = [rng.choice([1, 1, 2, 30, 400, 100_000]) for _ in range(rng.randint(0, 300))]
        bounds = [0, *np.cumsum(steps).tolist()]
        index = infill.fit(bounds, error=20)
        assert [index.at(r) for r in range(len(bounds))] == bounds
        assert np.abs(index.residuals).max() <= 21
    even = infill.fit(list(range(0, 10_000, 7)), error=20)
    assert len(even.ranks) == 1


def held(scanner, words, width):
    """Licenses of which some stretch of `width` times their length holds enough, by plain counting."""
    names = set()
    for x in scanner.statements:
        size = width * x.length
        for i in range(max(1, len(words) - size + 1)):
            part = words[i : i + size]
            there = {s for s in x.weights if any(tuple(part[j : j + len(s)]) == s for j in range(len(part)))}
            if sum(x.weights[s] for s in there) >= licenses.HOLDS * x.total and x.must <= there:
                names.add(x.name)
                break
    return names


@pytest.mark.parametrize("seed", range(4))
def test_licenses_equal_a_plain_containment_scan(seed):
    """Every license that a stretch of its length holds is found; none is that no window holds."""
    rng = random.Random(seed)
    wordings = {n: rng.sample(ts, min(3, len(ts))) for n, ts in licenses.WORDINGS.items()}
    scanner = licenses.Scanner(licenses.TEMPLATES, wordings)
    every = [t for ts in wordings.values() for t in ts] + list(licenses.TEMPLATES.values())
    plain = [f"w{i}" for i in range(60)] + ["under", "the", "license", "mit", "licensed", "of", "version", "gpl"]
    found_any = 0
    for _ in range(24):
        words = rng.choices(plain, k=rng.randrange(60))
        for text in rng.sample(every, rng.randrange(3)):
            copy = scanner.words(text)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["odd"], [copy[k], "odd"], [copy[k]]])
                copy = copy or ["odd"]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        spans = scanner.scan(" ".join(words))
        got = {n for n, _, _ in spans}
        assert held(scanner, words, 1) <= got <= held(scanner, words, 2)
        found_any += len(got)
        for name in got:
            own = sorted((a, b) for n, a, b in spans if n == name)
            assert all(b <= c for (_, b), (c, _) in zip(own, own[1:], strict=False))
    assert found_any > 5


def test_licenses_one_span_per_occurrence():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.WORDINGS)
    notice = licenses.TEMPLATES["BSD-notice"]
    text = f"{notice}. {notice}"
    assert scanner.scan(text) == [("BSD-notice", 0, len(notice)), ("BSD-notice", len(notice) + 2, len(text))]
    text = "Not released under the MIT License. Released under the MIT License"
    assert scanner.scan(text) == [("MIT", 4, 34), ("MIT", 36, 66)]
    assert scanner.scan("mit " * 3000) == [] and scanner.scan("") == []


def test_line_dedup_keeps_all_columns(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(3))
    rows = [(1, passage, "a", 1.5, None, 7), (2, f"own line\n{passage}", "b", 2.5, "g", 8), (None, None, "c", 3.5, "h", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _doc double, _gone string, n_removed int")
    out = line_dedup.dedup(df, 50)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r["_key"]: (r["doc_id"], r["text"], r["_doc"], r["_gone"], r["n_removed"]) for r in out.collect()}
    assert got == {"a": (1, passage, 1.5, None, 0), "b": (2, "own line", 2.5, "g", 3), "c": (None, None, 3.5, "h", 0)}


def test_quality_equals_a_plain_vote(spark):
    """All documents against all labelled ones, one product at a time; several texts and labels of a
    document, null and empty texts."""
    rng = random.Random(21)
    texts = {i: " ".join(rng.choices([f"{'xy'[i % 2]}{k}" for k in range(30)] + ["so", "it"], k=rng.randrange(1, 60))) for i in range(90)}
    rows = [*texts.items(), (200, None), (201, ""), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(4, 1), (7, None), (None, 1), (300, 1), (8, 5)]
    got = {r["doc_id"]: r["score"] for r in quality.score(df, spark.createDataFrame(labels, "doc_id long, label int")).collect()}
    known = {i: max(v for j, v in labels if j == i and v in (0, 1)) for i in range(60)}
    counted = {i: quality.counts([t])[0] for i, t in rows}
    space = quality.Space([zlib.compress(counted[i].tobytes()) for i in sorted(known)])
    vector = {i: space.vectors(c[None])[0] for i, c in counted.items()}
    compared = 0
    for i, v in vector.items():
        cosines = sorted(((float(v @ vector[j]), known[j]) for j in known), reverse=True)
        if cosines[quality.NEIGHBOURS - 1][0] - cosines[quality.NEIGHBOURS][0] < 1e-5:
            continue  # which of equally near neighbours votes is open
        compared += 1
        cosines = cosines[: quality.NEIGHBOURS]
        weights = [(math.exp(quality.SHARPNESS * (c - 1)), label) for c, label in cosines]
        wanted = sum(w * label for w, label in weights) / sum(w for w, _ in weights)
        assert got[i] == pytest.approx(wanted, abs=1e-3), i
    assert compared > 60 and 0 <= got[200] == got[201] <= 1
    assert {r["score"] for r in quality.score(df, spark.createDataFrame([], "doc_id long, label int")).collect()} == {0.5}


def test_mixing_shares_are_met_with_soft_posteriors(spark):
    """Domains that share most of their words: totals in the wanted proportion, near the largest."""
    rng = random.Random(31)
    words = {d: [f"{d}{k}" for k in "abcd"] + [f"c{k}" for k in range(8)] for d in ("en", "de", "fr")}
    rows = [(i, " ".join(rng.choices(words[("en", "de", "fr", "en")[i % 4]], k=rng.randrange(5, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, ("en", "de", "fr", "en")[i % 4]) for i in range(0, 400, 3)], "doc_id long, domain string")
    want = {"en": 0.2, "de": 0.5, "fr": 0.3}
    mixed = mixing.mix(df, known, want)
    sums = mixed.selectExpr(*[f"sum(tokens * p[{i}] * rate) got{i}" for i in range(3)], *[f"sum(tokens * p[{i}]) have{i}" for i in range(3)], "min(rate) lo", "max(rate) hi").first()
    total = sum(sums[f"got{i}"] for i in range(3))
    for i, share in enumerate(want.values()):
        assert sums[f"got{i}"] / total == pytest.approx(share, abs=5e-4)
    bound = min(sums[f"have{i}"] / share for i, share in enumerate(want.values()))
    assert 0.97 * bound <= total <= 1.001 * bound and 0 <= sums["lo"] <= sums["hi"] <= 1


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, row string, given_id long, tokens int, p0 double, _key string"


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names; empty tables."""
    rng = random.Random(41)
    good = {i: " ".join(rng.choices([f"{('en', 'de', 'fr', 'es')[i % 4]}{k}" for k in range(60)], k=60)) for i in range(120)}
    rows = [(i, t, ("en", "de", "fr", "es")[i % 4], "s", len(t), "r", -1, 5, 0.5, "k") for i, t in good.items()]
    rows += [(500, "$$$ !!! WIN " * 30, "en", "s", 9, "r", -1, 5, 0.5, "k"), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(501, "", "en", "s", 0, "r", 1, 1, 0.1, "k"), (502, " ".join(good[4].split() * 400), "en", "s", 1, "r", 1, 1, 0.1, "k"), rows[8], rows[8]]
    rows += [(None, good[12], "en", "s", 1, "r", 2, 1, 0.1, "k"), (None, good[12], "en", "s", 1, "r", 2, 1, 0.1, "k")]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(500, 0, 0), (None, 1, None), (3, None, None)]
    made = {"documents": spark.createDataFrame(rows, PIPELINE), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/some/{name}.parquet")
        df.where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs = corpus_pipeline.table(spark, f"{tmp_path}/some", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, f"{tmp_path}/some"), name)
        assert docs.columns == made["documents"].columns
        texts = {r.text for r in docs.collect()}
        assert "$$$ !!! WIN " * 30 not in texts
        if name == "quality":
            assert set(good.values()) <= texts
    kept = docs.collect()
    assert {r.row for r in kept} <= {"r", None} and {r["_key"] for r in kept} <= {"k", None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() == len(kept)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def stripped(page):
    """A page that says nothing of its elements: no class, id or role, and boxes without names."""
    page = re.sub(r'\s(class|id|role)="[^"]*"', "", page)
    return re.sub(r"<(/?)(nav|footer|article|header|aside|section|main)\b", r"<\1div", page)


def test_html_ratios_decide_without_marks(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = blocks = 0
    for page in pages:
        named, bare = html.blocks(page), html.blocks(stripped(page))
        wanted = ["article" in b.path.split("/") and not b.marked for b in named]
        assert html.content(named) == wanted
        right += sum(a == b for a, b in zip(wanted, html.content(bare), strict=True))
        blocks += len(named)
    assert right / blocks >= 0.95


@pytest.mark.parametrize("unit", ["<a ", '<a "> ', "<b>", "<div>", "<![CDATA[", "<!--x", "<button>", "</p>", "<p>x", "&lt;", '<a ">"', "<script>x", "<i>y", "<a b='", "<title>t", "<p><b>x", "</title"])
def test_html_takes_hostile_pages_in_linear_time(unit):
    start = time.process_time()
    html.main_text(unit * (200_000 // len(unit)))
    assert time.process_time() - start < 5


def test_html_tags_without_an_end():
    long = "A long sentence of the article, with commas, and with many more words than any menu has."
    for tag in ("button", "select", "svg", "title", "textarea", "iframe", "template"):
        assert long in html.main_text(f"<div><p>{long}</p><{tag}></div><div><p>{long} {long}</p></div>")
    assert html.main_text(f"<p>{long}</p><script>var a = '<p>{long}</p>'") == long


def test_html_on_odd_tables(spark):
    rows = [(1, "u", None), (None, None, "<p>Some text, here.</p>"), (3, "v", ""), (3, "v", ""), (4, "w", "<p>x</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html.extract(df).collect()]
    assert sorted(map(str, (r[:2] + (r[3],) for r in got))) == sorted(map(str, [(1, "u", 0), (None, None, 16), (3, "v", 0), (3, "v", 0), (4, "w", 20_000 + 2 * 19_999)]))
    assert html.extract(df.where("false")).count() == 0
