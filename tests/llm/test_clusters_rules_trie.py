"""Clusters, adaptive rules and conversation tries against plain re-statements, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import centroids, conversation_trie, quality_rules

CLASHING = ["vector", "cluster", "rank", "words", "lines", "turns", "head", "base", "key", "low", "rule", "n"]


@pytest.fixture(autouse=True)
def few_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def clash(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHING))


def means(rows, k, rounds, dims):
    """Every distance in every round."""
    kept = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [x for _, x in order[:k]]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for n in range(rounds + 1):
        near = [min(range(len(centers)), key=lambda c: (apart(x, centers[c]), c)) for _, x in kept]
        if n < rounds:
            for c in range(len(centers)):
                if members := [x for (_, x), m in zip(kept, near) if m == c]:
                    centers[c] = [sum(v) // len(members) for v in zip(*members)]
    far = [apart(x, centers[m]) for (_, x), m in zip(kept, near)]
    own = Counter()
    for m, d in zip(near, far):
        own[m] += d
    return [(i, m, d, own[m], sum(far), hashlib.sha256(",".join(map(str, centers[m])).encode()).hexdigest()) for (i, _), m, d in zip(kept, near, far)]


@pytest.mark.parametrize("k, scale", [(1, 1.0), (6, 0.02), (40, 3.0), (500, 1.0)])
def test_clusters(spark, k, scale):
    r = random.Random(k)
    base = [[r.gauss(0, scale) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, scale / 5) for x in base[i % 9]]) for i in range(150)]
    rows += [(900 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (None, rows[7][1])]  # ties, repeats, a null id
    rows += [(800, None), (801, []), (802, [1.0] * 5), (803, [1.0, None, 2.0, 3.0]), (804, [float("nan")] * 4), (805, [float("inf")] * 4), (806, [0.0] * 4)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = centroids.cluster_vectors(df, clusters=k, dims=4).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(means(rows, k, 5, 4), key=repr)


def test_clusters_of_extreme_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [v] * 64) for i, v in enumerate([1e300, -1e300, 0.0, 5e-324])], "vec_id long, embedding array<double>")
    assert {r.distance for r in centroids.cluster_vectors(df).collect()} == {0}
    assert max(r.distance for r in centroids.cluster_vectors(df, clusters=1).collect()) > 2 ** 55
    assert centroids.cluster_vectors(df.limit(0)).count() == 0


def test_search_measures_fewer_distances_than_all(monkeypatch):
    random_ = np.random.default_rng(3)
    places = random_.integers(-9000, 9000, size=(40, 8))
    x = places[random_.integers(40, size=3000)] + random_.integers(-200, 200, size=(3000, 8))
    seen, plain = [], centroids.squared
    at = centroids.Centroids(places)
    monkeypatch.setattr(centroids, "squared", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    near, *_ = at.assign(x, np.zeros(3000, np.int32), np.ones(3000, np.int32), np.full(3000, np.inf), np.zeros(3000))
    assert (near == np.array([((x - p) ** 2).sum(1) for p in places]).argmin(0)).all()
    first = sum(seen)
    seen.clear()
    moved = centroids.Centroids(places + 1, places)
    again, *_ = moved.assign(x, near, (near + 1) % 40, np.sqrt(plain(x, places[near]).astype(float)), np.full(3000, 1000.0))
    assert (again == np.array([((x - p - 1) ** 2).sum(1) for p in places]).argmin(0)).all()
    assert sum(seen) < 3000 < first


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {p for i, x in enumerate(windows) if many[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def bucket(v):
    shift = max(0, v.bit_length() - 6)
    return v >> shift << shift, (v >> shift << shift) + (1 << shift) - 1


def judged(rows, spread, min_docs):
    """(id, text, lang, source) rows -> the result rows."""
    told, values = [], defaultdict(list)
    for i, text, lang, source in rows:
        n, chars, symbols, again, covered, lines = counts(text)
        failed = n < 50 or 100 * covered > 50 * n
        v = (1000 * chars // max(n, 1), 10_000 * symbols // max(n, 1), 10_000 * covered // max(n, 1), 10_000 * again // max(lines, 1))
        told.append((i, n, chars, symbols, again, covered, failed, v, lang, source))
        if not failed:
            for level in ((lang, source), (lang,), ()):
                values[level].append(v)
    out = []
    for *row, failed, v, lang, source in told:
        kept = not failed
        if kept:
            held = next(values[x] for x in ((lang, source), (lang,), ()) if len(values[x]) >= min_docs or x == ())
            for k, (width, both) in enumerate(quality_rules.RULES.values()):
                s = sorted(x[k] for x in held)
                q1, q3 = bucket(s[-(-len(s) // 4) - 1])[0], bucket(s[-(-3 * len(s) // 4) - 1])[1]
                reach = spread * max(q3 - q1, width)
                kept &= v[k] <= q3 + reach and (not both or v[k] >= q1 - reach)
        out.append((*row, failed, kept))
    return out


def test_adaptive_rules(spark):
    r = random.Random(8)
    def say(n, size):
        return " ".join("".join(r.choice("abcdefgé😀") for _ in range(max(1, round(r.gauss(size, 1))))) for _ in range(n))
    rows = [(i, say(r.randint(40, 90), 12 if lang == "xx" else 5), lang, s) for i, (lang, s) in enumerate(
        r.choices([("en", "a"), ("en", "b"), ("xx", "a"), (None, "a"), ("xx", None), ("de", "rare")], weights=[90, 3, 60, 20, 5, 3], k=330))]
    rows += [(1000 + i, say(70, 20), lang, "a") for i, lang in enumerate(("en", "xx", None, "de"))]
    rows += [(2000, "# $ " * 60 + say(80, 5), "en", "a"), (2001, "a b c " * 40, "en", "a"), (2002, say(60, 5) + "\n x y z \nx y z\n x y z \r\n" * 3, "en", "a"), (2003, None, "en", "a"), (2004, "", None, None),
             (2005, "\n \t\n", "en", "b"), (None, say(60, 5), "en", "a"), rows[0], rows[0], (2006, say(30_000, 5), "en", "a"), (2007, "p q " * 26, "en", "a"), (2008, "p q", "en", "zz"), (2009, say(70, 1.5), "xx", "a")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = quality_rules.judge_documents(df, spread=1.5, min_docs=20).collect()
    want = judged(rows, 1.5, 20)
    assert sorted((tuple(x)[:-1] for x in got), key=repr) == sorted(want, key=repr)
    assert {x.kept for x in got} == {True, False} and all(x.kept == (not x.base_failed and not x.broken) for x in got)
    assert quality_rules.judge_documents(df.limit(0)).count() == 0
    assert quality_rules.judge_documents(df.where("doc_id in (2003, 2004)")).where("kept or not base_failed").count() == 0


def test_sketches_of_parts_merge_to_that_of_all(spark):
    values = spark.range(5000).selectExpr("cast(id % 3 as string) as part", "'x' as rule", "cast(pow(id, 1.7) as long) as value")
    whole = quality_rules.sketch(values, [])
    merged = quality_rules.sketch(values, ["part"]).groupBy("rule", "low", "high").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    assert whole.where("high - low > greatest(1, low) / 31").count() == 0


def test_no_python_on_the_rules_path(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = quality_rules.measure_texts(df, "doc_id", "text", "lang", "source")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    leaves, saved, out = {}, {}, []
    for p in members:
        if p:
            below[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in below[p]) or 1
        saved[p] = sum(saved[x] for x in below[p]) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    r = random.Random(4)
    say = [None, "", "hello", "tell me more", "x " * 500, "ünïcode words", "yes", "no"]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(say)) for c in range(120) for t in range(r.randint(1, 5))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 330) for t in range(4)]  # a large group of copies
    rows += [(c, t, "user", f"same {t}" if t < 60 else f"own {c} {t}") for c in range(400, 430) for t in range(64)]  # long common beginnings
    rows += [(501, 1, "user", "alone"), (502, None, "user", "first"), (502, 0, "user", "then"), (502, 0, "assistant", "tie"), (502, 0, "user", "then"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("container", [1, 40, 20_000])
def test_trie(spark, container):
    df = clash(spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string").repartition(5))
    got = conversation_trie.prefix_trie(df, container).collect()
    assert sorted(map(tuple, got), key=repr) == trie(talks())


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    for rows in ([(21, None, None, None)], [(5, 1, "u", "a b")], [(40, k, "u", f"w{k}") for k in range(3000)]):
        assert sorted(map(tuple, conversation_trie.prefix_trie(spark.createDataFrame(rows, schema), 10).collect()), key=repr) == trie(rows)
