"""Removal of byte strings that an earlier document has, by phrases cut at content-defined triggers.

Triggers (the smallest k-gram of each string, by hash) cut every text into phrases that depend on content
alone, so repeats give equal phrases wherever they stand.  Distinct phrases form the dictionary; the strings of a trigger
are grouped where they are equal; and each document's parse, its list of phrases, carries what was found there back to
the places of the text.  Of prefix-free parsing that is the first half: no suffix array of the dictionary or of the parse is
built, since only equality decides here.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.arrays import MIX2, SEGMENT, U64, Spans, buffer_of, distinct, mixed, packed
from corpuscope.llm.dealing import answers_of, buckets_of, count_keys, deal_texts, parts_of, table_of

#: Bits of the key by which a trigger is looked up before its phrases are sent.
FILTER_BITS = 40
PLACE_BITS = 22
LAST = np.iinfo(np.int64).max
#: Phrases whose surroundings are read at once.
CONTEXTS = 1 << 16


class Parse:
    """The phrases of all texts of a part.

    Every string of ``span`` bytes holds ``steps`` k-grams; the one with the smallest hash (the last
    such) is its trigger.  Strings that start next to each other and share the trigger form a phrase:
    starts[i] to stops[i] are the places where they start, triggers[i] that of the trigger."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int, k: int):
        self.data, self.offsets, self.k, self.steps = data, offsets, k, span - k + 1
        found: list[tuple] = []
        for a in range(0, max(len(data) - span + 1, 0), SEGMENT):
            b = min(a + SEGMENT, len(data) - span + 1)  # strings that start in [a, b)
            grams = Spans(data[a:b + span - 1]).grams(k)
            place = np.arange(len(grams), dtype=U64)
            least = (grams >> U64(PLACE_BITS) << U64(PLACE_BITS)) | (U64((1 << PLACE_BITS) - 1) - place)
            width = 1
            while 2 * width <= self.steps:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if extra := self.steps - width:
                least = np.minimum(least[:-extra], least[extra:])
            trigger = (U64((1 << PLACE_BITS) - 1) - (least & U64((1 << PLACE_BITS) - 1))).astype(np.int64)
            valid = np.ones(b - a, dtype=bool)
            for end in offsets[np.searchsorted(offsets, a, "right"):np.searchsorted(offsets, b + span - 1, "right")]:
                valid[max(end - span + 1 - a, 0):max(end - a, 0)] = False
            new = np.ones(b - a, dtype=bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
            first = np.flatnonzero(new & valid)
            closes = np.ones(b - a, dtype=bool)
            closes[:-1] = new[1:] | ~valid[1:]
            at = trigger[first]
            found.append((first + a, np.flatnonzero(closes & valid) + a, at + a, grams[at]))
        columns = list(zip(*found)) or [(np.zeros(0, np.int64),)] * 3 + [(np.zeros(0, U64),)]
        self.starts, self.stops, self.triggers, self.hashes = map(np.concatenate, columns)
        self.hashes = mixed(self.hashes, MIX2)  # the smallest of several hashes are spread again
        self.docs = np.searchsorted(offsets, self.triggers, "right") - 1
        self.keys = self.hashes >> U64(64 - FILTER_BITS)

    def counted_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigger keys in order and the number of texts that hold each."""
        order = np.argsort(self.keys, kind="stable")
        keys, docs = self.keys[order], self.docs[order]
        new_key = np.ones(len(keys), dtype=bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new_doc = new_key.copy()
        new_doc[1:] |= docs[1:] != docs[:-1]
        at = np.flatnonzero(new_key)
        return keys[at], np.add.reduceat(new_doc.astype(U64), at) if len(at) else np.zeros(0, U64)

    def select(self, chosen: np.ndarray) -> None:
        for name in ("starts", "stops", "triggers", "hashes", "docs", "keys"):
            setattr(self, name, getattr(self, name)[chosen])

    def contexts(self) -> np.ndarray:
        """Bytes before and after the trigger that the strings of each phrase cover; others are 0."""
        reach = self.steps - 1
        around = np.concatenate([np.arange(-reach, 0), self.k + np.arange(reach)])
        context = np.zeros((len(self.triggers), 2 * reach), np.uint8)
        for i in range(0, len(context), CONTEXTS):
            rows = slice(i, i + CONTEXTS)
            places = self.triggers[rows, None] + around
            inside = (places >= self.starts[rows, None]) & (places < (self.stops[rows] + self.k + reach)[:, None])
            context[rows] = np.where(inside, self.data[np.where(inside, places, 0)], 0)
        return context

    def dictionary(self, ids: np.ndarray):
        """Distinct phrases of the part: rows that stand for them, each row's number, and the smallest id of each."""
        context = self.contexts()
        before, after = (self.triggers - self.starts).astype(np.uint8), (self.triggers - self.stops).astype(np.uint8)
        whole = np.concatenate([self.hashes.view(np.uint8).reshape(-1, 8), before[:, None], after[:, None], context], axis=1)
        whole = np.pad(whole, ((0, 0), (0, -whole.shape[1] % 8)))
        words = np.ascontiguousarray(whole).view(U64)
        digest = np.zeros(len(words), U64)
        for column in words.T:
            digest = mixed(digest * MIX2 + column)
        # equal triggers stand together, in the order of the buckets
        order = np.lexsort((digest, self.hashes))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]) | (self.hashes[order][1:] != self.hashes[order][:-1])
        at = np.flatnonzero(new)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(ids[self.docs[order]], at) if len(at) else np.zeros(0, np.int64)
        rows = order[at]
        return rows, number, smallest, before[rows], after[rows], context[rows]


def earlier_strings(hashes: np.ndarray, before: np.ndarray, after: np.ndarray, context: np.ndarray, ids: np.ndarray, steps: int) -> np.ndarray:
    """For each phrase a number whose bit a tells that the string that starts a bytes before the trigger
    also stands in a phrase with a smaller id.

    A string is its trigger, known by its 64-bit hash, the distance a, and the ``steps`` - 1 bytes around it, compared as
    they are.  Equal strings are put side by side by a hash, and each run takes the smallest id of its phrases."""
    reach = steps - 1
    found = np.zeros(len(hashes), dtype=U64)
    for a in range(steps):
        rows = np.flatnonzero((after <= a) & (a <= before))
        if not len(rows):
            continue
        string = np.zeros((len(rows), -(-max(reach, 1) // 8) * 8), np.uint8)
        string[:, :reach] = context[rows, reach - a:2 * reach - a]
        words = string.view(U64)
        digest = hashes[rows]
        for column in words.T:
            digest = mixed(digest * MIX2 + column)
        order = np.argsort(digest)
        digest, words, trigger, own = digest[order], words[order], hashes[rows][order], ids[rows][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digest[1:] != digest[:-1]) | (trigger[1:] != trigger[:-1]) | (words[1:] != words[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        smallest = np.repeat(np.minimum.reduceat(own, at), np.diff(at, append=len(order)))
        found[rows[order]] |= (smallest < own).astype(U64) << U64(a)
    return found


def covered(parse: Parse, bits: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 places of the strings that go, merged where they touch; texts stay apart."""
    places = []
    for a in range(parse.steps):
        at = parse.triggers[(bits >> U64(a)) & U64(1) == 1] - a
        places.append(at)
    starts = distinct(np.concatenate(places)) if places else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts
    doc = np.searchsorted(parse.offsets, starts, "right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (starts[1:] > starts[:-1] + span) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return starts[first], np.append(starts[first[1:] - 1], starts[-1]) + span


PHRASES = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "before", "after", "context", "ids"))])
RESULT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string(),
          "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}
FOUND = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def in_order(table: pa.Table) -> pa.Table:
    """The rows as every task must see them, whatever order the shuffle gave: segments may cut a phrase
    in two, and where they do depends on the texts before."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> np.ndarray:
    return np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)


def dedup_substrings(docs: DataFrame, span: int = 50, k: int = 34, with_text: bool = True, carry: tuple[str, ...] = (),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from every text the bytes of each string of ``span`` bytes that a document of smaller id has.

    1. Parts send the keys of their triggers; buckets answer which occur in several texts.
    2. Phrases with such triggers, once per part and with the smallest id there, go to the bucket of
       the trigger, which finds the equal strings of its part of the dictionary.
    3. Its answers, one bit for each string of a phrase, go back to the part, whose parse turns them
       into places of its texts.

    All strings are judged as given, not on what is left.  Null texts are empty; null ids count as
    larger than all others; rows of equal id do not remove from one another; an empty table gives no
    rows; other columns are read only if ``carry`` names them, and come back as ``row_<name>``.
    Result: id, n_bytes, n_removed, n_spans, spans (first and last + 1 byte of each maximal removed
    run), kept_text (what remains, with ``with_text``; characters of which only a part remains are left
    out of it), kept_sha256 (of all bytes that remain), carried columns.
    """
    buckets, steps = parts_of(docs.sparkSession), span - k + 1
    if not 1 <= steps <= 60:
        raise ValueError("a string must hold between 1 and 60 k-grams")
    dealt = deal_texts(docs, id_col, text_col, *(F.col(c).alias(f"row_{c}") for c in carry))

    def parse_of(table: pa.Table) -> Parse:
        return Parse(*buffer_of(in_order(table).column("text")), span, k)

    def shared_only(parse: Parse, classes: np.ndarray) -> Parse:
        _, number = np.unique(parse.keys, return_inverse=True)
        parse.select(classes[number] > 0)
        return parse

    shared = count_keys(dealt, lambda table: parse_of(table).counted_keys(), FILTER_BITS, lambda sums: (sums > 1).astype(U64))

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return table_of([], PHRASES)
        parse = shared_only(parse_of(table), answers_of(answers))
        rows, _, smallest, before, after, context = parse.dictionary(ids_of(in_order(table)))
        hashes, part = parse.hashes[rows], table.column("part")[0].as_py()
        cuts = np.searchsorted(buckets_of(hashes, 64, buckets), np.arange(buckets + 1).astype(U64))
        columns = (hashes, before, after, context, smallest)
        return table_of([(part, b, *(c[x:y].tobytes() for c in columns)) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x], PHRASES)

    def judge(table: pa.Table) -> pa.Table:
        blocks = {name: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in
                  (("hashes", U64), ("before", np.uint8), ("after", np.uint8), ("context", np.uint8), ("ids", np.int64))}
        hashes, before, after, context, ids = map(np.concatenate, blocks.values())
        bits = earlier_strings(hashes, before, after, context.reshape(len(hashes), -1), ids, steps)
        ends = np.cumsum([len(h) for h in blocks["hashes"]])
        bucket = table.column("bucket")[0].as_py()
        return table_of([(p, bucket, packed(bits[e - len(h):e])) for p, h, e in zip(table.column("part").to_pylist(), blocks["hashes"], ends)], FOUND)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        table = in_order(table)
        data, offsets = buffer_of(table.column("text"))
        answers, found = (told.filter(pc.equal(told.column("step"), step)) for step in (1, 2))
        firsts = lasts = np.zeros(0, np.int64)
        if found.num_rows:
            ids = ids_of(table)
            parse = shared_only(Parse(data, offsets, span, k), answers_of(answers))
            _, number, smallest, *_ = parse.dictionary(ids)
            own = (U64(2) << (parse.triggers - parse.starts).astype(U64)) - U64(1)
            own &= ~((U64(1) << (parse.triggers - parse.stops).astype(U64)) - U64(1))
            bits = np.where(smallest[number] < ids[parse.docs], own, answers_of(found)[number] & own)
            firsts, lasts = covered(parse, bits, span)
        cuts = np.searchsorted(firsts, offsets)
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256")}
        for i in range(table.num_rows):
            a, b = offsets[i], offsets[i + 1]
            here = slice(cuts[i], cuts[i + 1])
            spans = list(zip((firsts[here] - a).tolist(), (lasts[here] - a).tolist()))
            text, kept, at = data[a:b].tobytes(), [], 0
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            kept = b"".join([*kept, text[at:]])
            for name, value in zip(out, (len(text), len(text) - len(kept), len(spans), [{"start": x, "stop": y} for x, y in spans],
                                         kept.decode("utf-8", "ignore") if with_text else None, hashlib.sha256(kept).hexdigest())):
                out[name].append(value)
        arrays = {"doc_id": table.column("doc_id")} | {n: pa.array(v, RESULT[n]) for n, v in out.items()}
        return pa.table(arrays | {f"row_{c}": table.column(f"row_{c}") for c in carry})

    sent = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        send, "part int, bucket int, hashes binary, before binary, after binary, context binary, ids binary")
    found = sent.groupBy("bucket").applyInArrow(judge, "part int, bucket int, blob binary")
    told = shared.withColumn("step", F.lit(1)).unionByName(found.withColumn("step", F.lit(2)))
    rows = "".join(f", row_{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in carry)
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, "
        f"kept_text string, kept_sha256 string{rows}").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256", *(f"row_{c}" for c in carry))
