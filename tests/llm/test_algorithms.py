"""Spans, percentiles, pairs, pieces and mixing against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("cairn.llm")
from cairn.llm import mixing, pieces, quantiles, spans, together

MEMBERS = "member_id long, run_id long, tokens array<string>, pos int, h1 string"


def brute_spans(rows, m):
    where = defaultdict(set)
    for k, r, t, *_ in rows:
        if t is not None and r is not None and k is not None:
            for i in range(len(t) - m + 1):
                where[r, tuple(t[i : i + m])].add(k)
    out = set()
    for k, r, t, *_ in rows:
        if t is None or r is None or k is None:
            continue
        hit = [False] * len(t)
        for i in range(len(t) - m + 1):
            if len(where[r, tuple(t[i : i + m])]) > 1:
                hit[i : i + m] = [True] * m
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and hit[j]:
                j += 1
            if j > i:
                out.add((k, i, j))
            i = j + 1
    return out


@pytest.mark.parametrize("m", [1, 3, 5])
def test_spans(spark, m):
    rng = random.Random(m)
    base = [rng.choice("abcd") for _ in range(60)]
    rows = [(i, i % 2, (lambda a, n: base[a : a + n] + [rng.choice("wxyz") for _ in range(6)] + base[40:55])(rng.randrange(30), rng.randrange(0, 25)), 0, "") for i in range(14)]
    rows += [(20, 0, None, None, None), (21, 0, [], 1, "x"), (22, None, base, 1, "x"), (23, 1, [None, None, "a", None, None, "a"], 1, "x"), (24, 1, [None, None, "a"], 1, "x"), (24, 1, [None, None, "a"], 1, "x")]
    df = spark.createDataFrame(rows, MEMBERS)
    assert {tuple(r) for r in spans.shared_spans(df, m).collect()} == brute_spans(rows, m)
    got = {r["member_id"]: (r["n_tokens"], r["shared_tokens"]) for r in spans.shared_report(df, m).collect()}
    want = Counter()
    for k, a, b in brute_spans(rows, m):
        want[k] += b - a
    assert all(got[k] == (len(t or []), want[k]) for k, _, t, *_ in rows)


def test_levels_double_until_none_is_left(spark):
    t = [f"t{i}" for i in range(45)]
    df = spark.createDataFrame([(1, 1, ["a", *t], 0, ""), (2, 1, ["b", *t], 0, ""), (3, 1, t[:12], 0, "")], MEMBERS)
    levels = Counter(r["length"] for r in spans.repeated_windows(df, 5).collect())
    assert levels == {5: 2 * 41 + 8, 10: 2 * 36 + 3, 20: 2 * 26, 40: 2 * 6}
    assert spans.shared_spans(df.limit(0), 5).count() == 0


def test_percentiles_are_certified_and_combine(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "b", i % 4, float(int(rng.lognormvariate(2, 1.5)))) for i in range(9000)] + [(None, 1, 2.0), ("c", 0, None), ("c", 0, float("nan")), ("d", 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    counts = quantiles.value_counts(df, ["g", "day"], "v")
    days = quantiles.digest(counts, ["g", "day"], 200.0)
    merged = quantiles.merge(days, ["g"], 200.0)
    total = quantiles.value_counts(df, ["g"], "v")
    qs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    sure = quantiles.certify(quantiles.quantiles(merged, ["g"], qs), total, ["g"]).collect()
    assert len(sure) == 4 * len(qs)
    by = defaultdict(list)
    for g, _, v in rows:
        if v is not None and v == v:
            by[g].append(v)
    for r in sure:
        vs = by[r["g"]]
        assert r["n_counted"] == len(vs)
        below, most = sum(v < r["estimate"] for v in vs), sum(v <= r["estimate"] for v in vs)
        assert (r["below"], r["at_most"]) == (below, most)
        assert r["rank_error"] <= quantiles.error_bound(r["q"], 200.0) + 1 / len(vs)
    assert quantiles.digest(counts.limit(0), ["g", "day"]).count() == 0


def test_symbol_rules(spark):
    import datetime as dt

    t = dt.datetime(2031, 1, 6, 3)
    s = "run_id long, repo_id long, node_id string, file_path string, measured_at timestamp, complexity int, q string"
    rows = [(1, 1, "a", "src/x/a.py", t, 4, ""), (1, 1, "a", "src/x/a.py", t, 4, ""), (1, 1, "b", "src/x/b.py", t, 8, ""), (1, 1, "c", "src/c.py", t, -1, ""), (1, 1, "d", "src/c.py", t, None, ""), (1, None, "e", None, None, 3, "")]
    got = {(r["level"], r["repo_id"], r["module"], r["q"]): (r["n"], r["avg"]) for r in quantiles.symbol_percentiles(spark.createDataFrame(rows, s)).collect()}
    assert got["day", 1, "src/x", 0.5] == (2, 6.0) and got["repo", 1, None, 0.9] == (2, 6.0) and got["repo", None, None, 0.5] == (1, 3.0)


@pytest.mark.parametrize("chunk, most", [(2, None), (3, None), (100, None), (2, 5)])
def test_pairs(spark, chunk, most):
    rng = random.Random(chunk)
    baskets = {(g, b): rng.sample(range(30), rng.choice([1, 2, 3, 5, 14])) for g in (1, 2) for b in range(12)}
    rows = [(g, f"b{b}", f"f{i}", 0) for (g, b), items in baskets.items() for i in items for _ in range(rng.choice([1, 2]))]
    rows += [(None, "b", "f1", 0), (1, None, "f1", 0), (1, "b1", None, 0)]
    count, one, total = Counter(), Counter(), Counter()
    for (g, _), items in baskets.items():
        if most and len(items) > most:
            continue
        total[g] += 1
        names = sorted(f"f{i}" for i in items)
        one.update((g, x) for x in names)
        count.update((g, a, b) for a, b in combinations(names, 2))
    df = spark.createDataFrame(rows, "g long, b string, i string, n int")
    for least in (1, 2):
        got = {(r["g"], r["item_a"], r["item_b"]): (r["baskets"], r["count_a"], r["count_b"], r["shared"]) for r in together.cooccurrence(df, "g", "b", "i", max_items=most, min_shared=least, chunk=chunk).collect()}
        assert got == {k: (total[k[0]], one[k[0], k[1]], one[k[0], k[2]], n) for k, n in count.items() if n >= least}
    assert together.cooccurrence(df.limit(0), "g", "b", "i").count() == 0


def check_pieces(data: bytes, limit: int, overlap: int):
    got = pieces.split(data, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(data)
    for a, b in got:
        assert 0 < b - a <= limit or len(data) == 0
        data[a:b].decode()
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d
        assert b - c <= overlap * 1.3 + 4 and (overlap == 0 or b - c >= overlap * 0.7 - 4)
    return got


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\té漢😀{}"), max_size=900), st.integers(40, 200), st.integers(0, 20))
def test_any_text_splits(text, limit, overlap):
    check_pieces(text.encode(), limit, overlap)


def test_natural_cuts(spark):
    text = "".join(f"def f{i}():\n    a = {i}\n    b = a\n    return b\n\n" for i in range(60))
    for a, _ in check_pieces(text.encode(), 500, 0)[1:]:
        assert text.encode()[a:].startswith(b"def ")
    check_pieces(b"x" * 5000, 300, 30)
    check_pieces(("字" * 3000).encode(), 300, 30)
    df = spark.createDataFrame([(1, text, 5), (2, "short", 5), (3, "", 5), (4, None, 5)], "file_id long, content string, k int")
    rows = pieces.split_column(df, 500, 50).orderBy("file_id", "piece_no").collect()
    assert [r["piece"] for r in rows if r["file_id"] > 1] == ["short", ""]
    assert all(r["piece"].encode() == text.encode()[r["start_byte"] : r["end_byte"]] for r in rows if r["file_id"] == 1)
    slim = pieces.split_column(df, 500, 50, text=False)
    assert slim.where("n_pieces > 1").select("file_id").distinct().collect()[0][0] == 1 and slim.count() == len(rows)


WEIGHTS = [("wiki", 0.5, 1), (" Issues ", 0.25, 2), ("tiny", 0.25, 3), ("none", 0.2, 1), (None, 0.3, 1), ("zero", 0.0, 1)]


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), "Wiki" if i % 10 < 6 else "issues ") for i in range(600)] + [(1000 + i, "a few tokens here", "tiny") for i in range(40)] + [(2000, None, "wiki"), (2001, "", "wiki"), (2002, "x", None), (2003, "x", "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    w = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    mix = mixing.mix(d, w).cache()
    rows = mix.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 642
    caps = {"wiki": 1, "issues": 2, "tiny": 3}
    assert all(0 <= r["copies"] <= caps[r["source"]] and abs(r["copies"] - r["rate"]) <= 1 + 1e-6 for r in rows)
    share = {r["source"]: r["actual_share"] for r in mixing.shares(mix, w).collect()}
    assert share["none"] == 0 and abs(share["wiki"] - 0.5) < 0.01 and abs(share["issues"] - 0.25) < 0.01 and abs(share["tiny"] - 0.25) < 0.01
    assert all(r["copies"] == 3 for r in rows if r["source"] == "tiny")  # the source that limits the total is used up
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(d.repartition(7), w).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    assert mixing.mix(d.limit(0), w).count() == 0 and mixing.mix(d, w.limit(0)).count() == 0


def test_every_pair_of_files_comes_out(spark, tmp_path):
    from cairn.llm import queries

    commits = {(1, "c0"): ["src/a.py", "./src//b.py"], (1, "c1"): ["src/a.py", "src\\b.py", "src/c.py"], (2, "c0"): ["src/a.py"], (2, "c1"): [f"f{i:02}" for i in range(60)]}
    spark.createDataFrame([(g, c, f) for (g, c), files in commits.items() for f in files], 'repo_id long, `commit` string, file string').write.parquet(f"{tmp_path}/commit_files.parquet")
    got = {(r["repo_id"], r["file_a"], r["file_b"]): (r["commits"], r["commits_a"], r["commits_b"], r["shared_commits"], r["lift"]) for r in queries.p3_pairs(spark, str(tmp_path)).collect()}
    want = {(1, "src/a.py", "src/b.py"): (2, 2, 2, 2, 1.0), (1, "src/a.py", "src/c.py"): (2, 2, 1, 1, 1.0), (1, "src/b.py", "src/c.py"): (2, 2, 1, 1, 1.0)}
    assert got == want | {(2, a, b): (2, 1, 1, 1, 2.0) for a, b in combinations([f"f{i:02}" for i in range(60)], 2)}
    assert queries.p3_found(spark, str(tmp_path)).count() == 0


def test_every_line_start_and_white_space_may_be_cut():
    text = b"".join(b"    line %03d\n" % i for i in range(400))
    pos, _ = pieces.boundaries(text, 6000)
    assert set(pos.tolist()) == {i + 1 for i, c in enumerate(text[:-1]) if c == 10}
    words = b" ".join(b"w%04d" % i for i in range(2000))
    pos, pen = pieces.boundaries(words, 6000)
    assert pos.tolist() == [i + 1 for i, c in enumerate(words) if c == 32] and set(pen.tolist()) == {pieces.SPACE}
    check_pieces(words + b"x" * 20_000 + "字".encode() * 5000, 6000, 600)
