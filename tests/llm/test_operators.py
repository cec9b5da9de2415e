"""Every operator against a plain re-statement, and on odd tables: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpuscope.llm import (
    cap_filters, catalogue, decontaminate, jaccard_join, lm_scoring, mixing, quality, suffix_dedup, token_counts, url_filters, warc)
from corpuscope.llm.common import new_folder, prefix_sums
from corpuscope.llm.components import block_pairs, components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CLASHING = ["part", "bucket", "words", "key", "size", "target", "label_", "keep", "node", "digest", "hits", "row", "before_size", "n", "d", "p"]


@pytest.fixture(autouse=True)
def few_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def odd_texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage, long = say(60), say(30), say(30_000)
    texts = [None, "", "   \n\t", "one", "One  two", base, base.upper(), base + " tail", base.replace(" ", "  "), "x" * 3000, "é" * 60, "x" * 3000,
             say(20) + " " + passage + " " + say(25), say(33) + ". " + passage + "; " + say(5), passage, long, long[:5000] + " cut " + long[5100:], "\x00a\x00" * 30]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base), (None, None), (None, passage + " more")]
    rows += [(1000 + i, " ".join(w if r.random() > 0.01 else "changed" for w in base.split()) + f" v{i}") for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, None if k % 5 == 4 else f"s{k % 3}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHING))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_url_filters(spark):
    urls = [None, "", "no scheme", "https://com/", "http://A.Example.com/en/x?q=/fr/", "http://www.example.com/en/", "http://b.www.example.com/en/y", "http://example.com/EN/",
            "http://example.com", "https://x.net/es/", "https://net/fr/z#f", "https://notexample.com.net/es", "https://x.org/shop/cart/1", "https://x.com/cart/", "x://y://z.net/es/"]
    pages = spark.createDataFrame([(i, u, "h", "t", "p") for i, u in enumerate(urls + urls[3:5])], "page_id long, url string, host string, target string, path string")
    got = {r[0]: tuple(r)[1:] for r in url_filters.filter_urls(pages, catalogue.URL_RULES, catalogue.URL_PATTERNS).collect()}
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    for i, u in enumerate(urls + urls[3:5]):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = lower(rest[:cut]), rest[cut:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(r), r, a) for r, a in catalogue.URL_RULES
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        rule, action = max(fits)[1:] if fits else (None, "block" if "/cart/" in path else "allow")
        assert got[i][:4] == (host, path, rule, action), u
    assert url_filters.filter_urls(pages.limit(0), catalogue.URL_RULES).count() == 0
    assert url_filters.filter_urls(pages, []).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filters.whole_tokens("/ab/cd", start=False) == ["ab"] and url_filters.whole_tokens("ab.cd/e", start=True) == ["ab", "cd"]


def test_url_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = rows_of(url_filters.filter_urls(pages, catalogue.URL_RULES, catalogue.URL_PATTERNS))
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    assert rows_of(url_filters.filter_urls(pages, catalogue.URL_RULES, catalogue.URL_PATTERNS)) == want


def test_quality_agrees_with_labels(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = quality.score_quality(docs.withColumn("keep", F.lit(1))).drop("quality").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    counts = {(r["keep"], r["quality"]): r["count"] for r in scored.groupBy("keep", "quality").count().collect()}
    good, bad = counts.get((True, 1), 0), counts.get((False, 0), 0)
    assert good / (good + counts.get((False, 1), 0)) > 0.97 and bad / (bad + counts.get((True, 0), 0)) > 0.9
    got = quality.score_quality(odd)
    assert got.count() == odd.count() and got.where("trim(coalesce(text, '')) = '' and keep").count() == 0 and set(CLASHING) < set(got.columns)
    assert quality.score_quality(odd.limit(0)).count() == 0


def test_votes_are_weighed():
    votes = np.array([[1, 1, 1], [-1, 1, 1], [1, -1, 0], [0, 0, 0], [-1, -1, -1]])
    good = quality.estimate(votes, np.array([900.0, 40, 30, 20, 60]))
    assert good[0] > 0.9 and good[4] < 0.1 and good[1] < good[0]


def test_language_model(spark, odd):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 2000 else r.text[:700]) for r in odd.collect()]
    short = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, part string, held_out string")
    got = sorted(lm_scoring.score_texts(short).collect(), key=repr)
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [(t or "") for (_, t), h in zip(rows, held) if not h]
    base = brute.base_scores(train, [t for _, t in rows])
    score = brute.tree_scores([t.encode() for t in train], [(t or "").encode() for _, t in rows])
    want = sorted(zip([i for i, _ in rows], held, base, score), key=lambda x: repr((x[0], x[1], *x[2][:2])))
    got = sorted(got, key=lambda r: repr((r.doc_id, r.held_out, r.n_tokens, r.n_known)))
    for g, (i, h, b, s) in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (i, h, *b[:3])
    assert np.allclose(sorted(g.base_score for g in got), sorted(b[3] for b in base)) and np.allclose(sorted(g.score for g in got), sorted(score), rtol=1e-4)
    assert lm_scoring.score_texts(short.limit(0)).count() == 0
    assert lm_scoring.score_texts(short.where("doc_id is null"), held_fold=0).first().train_tokens == 0


def test_language_model_beats_single_words(spark):
    got = lm_scoring.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 1.05 * got[1]  # logarithms: less is worse


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, odd, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    texts = [r.text for r in odd.collect()]
    items = [(1, texts[14]), (2, "One two"), (3, None), (4, ""), (5, "ONE"), (None, texts[12]), (2, texts[5][:80]), (1, texts[14])]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in decontaminate.find_contamination(odd.fillna(-1), bench).collect())
    want = []
    for r in odd.fillna(-1).collect():
        n, hit, found = brute.contamination(r.text, items)
        want.append((r.doc_id, n, hit, found, hit > 0))
    assert got == sorted(want)
    assert decontaminate.find_contamination(odd, bench).count() == odd.count()
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontaminate.find_contamination(odd.limit(0), bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, None, "only\r\n\r\nme"), (5, "u", "z" * 3_000_000), (2, None, "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = rows_of(warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    payload = lambda h: (h or "").encode()
    newest = {p: max([i for i, _, h in rows if payload(h) == p and i is not None], default=None) for p in {payload(h) for *_, h in rows}}
    want = [(i, len(p), warc.base32_sha1(p), *(("response", None) if i == newest[p] else ("revisit", newest[p]))) for i, _, h in rows for p in [payload(h)]]
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert warc.archive_pages(pages, min_bytes=10).where("record_type = 'revisit'").count() == 0
    back = {r.page_id: r for r in warc.archive_pages(pages).where("record_type = 'response'").collect()}
    assert bytes(back[5].payload) == b"z" * 3_000_000
    whole = {r.page_id: r for r in warc.archive_pages(pages, min_bytes=10).collect() if r.page_id in (1, 3)}  # below ten bytes each is a response
    assert bytes(whole[1].payload) == "<p>é</p>".encode() and whole[1].url == "http://a/ X: y" and whole[3].url == "u"


def test_warc_members_stand_alone(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = warc.write_archives(warc.record_kinds(pages), new_folder(spark, "mono"))
    index = warc.normalise(files, new_folder(spark, "parts"), delete_source=True).collect()
    again = {r.file for r in index}
    assert len(index) == pages.count()
    for path in again:
        _, name = warc.opened(path)
        data = open(name, "rb").read()
        for r in index:
            if r.file == path:
                assert zlib.decompress(data[r.offset:r.offset + r.length], 31).startswith(b"WARC/1.1\r\n")
        assert sum(r.length for r in index if r.file == path) == len(data)
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


def test_token_counts_and_cache(spark, odd):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "cache")
    special = spark.createDataFrame([(7, "a <|endoftext|> b<|endoftext|>c \n\n x  y"), (8, "it's  we'll\tgo 12 345 !!! don't")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(special)
    library = Tokenizer.from_file(path)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()), key=repr)
    assert rows_of(token_counts.count_tokens(docs, path, cache)) == want
    assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert rows_of(token_counts.count_tokens(docs, path, cache)) == want and spark.read.parquet(cache).count() == spark.read.parquet(cache).distinct().count()
    assert token_counts.count_tokens(docs.limit(0), path, new_folder(spark, "cache")).count() == 0
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    got = token_counts.count_tokens(special, model, cache).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {r.doc_id: len(pieces.encode(r.text)) for r in special.collect()}


def test_substring_dedup(spark, odd):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 10_000 else r.text[:9000]) for r in odd.collect()]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, part string, place int")
    got = {r.row_place: r for r in suffix_dedup.dedup_substrings(docs, carry=("place", "part")).collect()}
    for k, ((i, t), flags) in enumerate(zip(rows, brute.repeats(rows), strict=True)):
        b = (t or "").encode()
        kept = bytes(x for x, f in zip(b, flags) if not f)
        runs = sum(f and (p == 0 or not flags[p - 1]) for p, f in enumerate(flags))
        r = got[k]
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (i, len(b), sum(flags), runs, hashlib.sha256(kept).hexdigest()), k
        assert r.kept_text == kept.decode("utf-8", "ignore") and all(all(flags[s.start:s.stop]) for s in r.spans)
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_segments_do_not_matter(monkeypatch):
    r = np.random.default_rng(1)
    data, offsets = r.integers(97, 100, 5000, dtype=np.uint8), np.array([0, 10, 10, 1500, 3000, 3049, 5000])
    whole = suffix_dedup.Parse(data, offsets, 50, 34)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    cut = suffix_dedup.Parse(data, offsets, 50, 34)
    places = lambda p: [(s, t) for a, z, t in zip(p.starts, p.stops, p.triggers) for s in range(a, z + 1)]
    assert places(whole) == places(cut) and len(places(whole)) == sum(max(n - 49, 0) for n in np.diff(offsets))


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(spark, odd, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows += [(2000 + i, " ".join(w if r.random() > 0.025 else f"q{r.randint(0, 9)}" for w in base)) for i in range(40)]
    known = [x for x in rows if x[0] is not None]
    got = {}
    for x in jaccard_join.join_similar(spark.createDataFrame([(*x, "m") for x in known], "doc_id long, text string, set_id string")).collect():
        assert got.setdefault(x.doc_id, (x.n_shingles, x.component_id)) == (x.n_shingles, x.component_id)
    groups = brute.similar_groups([t for _, t in known])
    least = {}
    for k, (_, g) in groups.items():
        least[g] = min(least.get(g, 10 ** 9), known[k][0])
    assert got == {known[k][0]: (n, least[g]) for k, (n, g) in groups.items()}
    assert jaccard_join.join_similar(odd).count() == odd.count() and jaccard_join.join_similar(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and rows_of(mixing.mix_sources(odd)) == sorted(map(tuple, got), key=repr)
    sizes = {}
    for r in got:
        sizes.setdefault(r.source, [0, 0, r.target])
        sizes[r.source][0] += r["size"]
        sizes[r.source][1] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    total, caps = sum(s[0] for s in sizes.values()), {k: 2.0 * s[0] for k, s in sizes.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, full = {}, set()
    while True:
        level = (1.5 * total - sum(caps[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        want = {s: caps[s] if s in full else level * weight[s] for s in order}
        if not (new := {s for s in order if want[s] > caps[s]} - full):
            break
        full |= new
    for s, (_, taken, target) in sizes.items():
        assert abs(target - want[s]) < 1e-6 * max(1, target) and taken == int(target)
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(odd.where("trim(coalesce(text, '')) = ''")).where("taken > 0").count() == 0


def test_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 64))
    X = np.repeat(centres, 8, axis=0) + 0.25 * r.standard_normal((320, 64))
    rows = [(i, x.tolist(), i // 8 % 3) for i, x in enumerate(X)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], None), (902, None, 1), (903, [], 1), (904, [0.0] * 64, 1), (905, [float("nan")] * 64, 1),
             (906, [None] * 64, 1), (907, [1e300] * 64, 1), (908, [2.0] * 64, 1), (909, [1.0, 2.0], 1), (None, rows[9][1], rows[9][2]), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*x, "n", "l") for x in rows], "vec_id long, embedding array<double>, label int, node string, filters string")
    got = cap_filters.near_duplicates(df).collect()
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    pairs = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    found, true = sum(x.n_links for x in got), 2 * len(pairs)
    assert len(got) == len(rows) and 0.95 * true <= found <= true and true > 500
    assert all(x.n_links == 0 and x.component_id == x.vec_id and x.kept for x in got if x.vec_id in range(901, 907))
    group = brute.roots(pairs, range(len(rows)))
    want = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            want[group[k]] = min(want.get(group[k], 10 ** 9), i)
    right = sum((x.component_id == want.get(group[k])) for k, (i, *_) in enumerate(rows) for x in got if x.vec_id == i and i is not None and i != 3)
    assert right >= 0.95 * len(rows)
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_small_blocks(spark, monkeypatch):
    rows = [(i, [1.0, i / 1000, 0.5], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(cap_filters, "BLOCK", 4)
    got = cap_filters.near_duplicates(df, cap=-2.0, directions=2, blocks=2).collect()
    assert all(r.n_links == 29 and r.component_id == 0 and r.kept == (r.vec_id == 0) for r in got)


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p}
    assert got == brute.roots(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_meet(spark):
    rows = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1)], "g string, m int")
    got = block_pairs(rows, ["g"], "m", 8).collect()
    met = {(a.m, b.m) for a in got for b in got if a.g == b.g == "g" and (a.block_a, a.block_b) == (b.block_a, b.block_b)}
    assert len(met) == 2500


def test_prefix_sums(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), F.lit(2).alias("v"))
    assert all(r.before_v == 2 * r.k for r in prefix_sums(df, [F.col("k")], ["v"]).collect())


def test_counting_grams_takes_memory_by_distinct_grams():
    import tracemalloc

    text = np.frombuffer((b"the quick brown fox jumps over the lazy dog; " * 25_000)[:1 << 20], np.uint8)
    rng = np.random.default_rng(5)

    def peak(copies):
        data = np.tile(np.concatenate([text[:-200_000], rng.integers(97, 123, 200_000).astype(np.uint8)]), copies)
        offsets = np.arange(copies + 1) * len(text)
        tracemalloc.start()
        keys, counts = lm_scoring.gram_counts(data, offsets, np.arange(copies) % 3 != 0, 5)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert counts.sum() == (len(text) + 1) * sum(i % 3 != 0 for i in range(copies)) and np.all(np.diff(keys.astype(object)[:1000]) > 0)
        return top

    assert peak(24) < 1.4 * peak(6)


def test_kept_documents_are_taken_apart_once(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality.score_quality(docs).where("keep").explain()
    plan = capsys.readouterr().out
    assert plan.count("\\p{Ll}+") == 1 and plan.count("split(") == 2  # words, and their shapes


def test_only_open_sets_are_compared_again(spark, monkeypatch):
    seen, compared = [], jaccard_join.open_pairs
    monkeypatch.setattr(jaccard_join, "open_pairs", lambda named, *more: seen.append(named.count()) or compared(named, *more))
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.025 else f"q{r.randint(0, 9)}" for w in base)) for i in range(40)]
    jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(seen) == 1 or all(later < seen[0] for later in seen[1:])


def test_mix_counts_words_once(spark, odd, monkeypatch):
    stored, plans = mixing.stored, []  # the ranges are sampled and dealt from what is stored
    monkeypatch.setattr(mixing, "stored", lambda df: plans.append(df._jdf.queryExecution().toString().count("split(")) or stored(df))
    mixing.mix_sources(odd).count()
    assert len(plans) == 1 and plans[0] > 0
