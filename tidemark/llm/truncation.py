"""Texts that stop before their author did.

The words of all texts form a vocabulary trie whose nodes hold how often the
words below them occur. A text whose last token is no known word but a proper
prefix of known ones stops inside a word. Where the last token is a word, the
corpus tells whether its context ever ends a sentence or line. Structures
(objects, fences, tables, log lines) must be closed. Marks that cutting
programs leave, lengths at which a source piles up, and a larger declared
length are further evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import clean_name
from tidemark.llm.arrays import chunks, summed
from tidemark.storage import written

_tok = re.compile(r"[一-鿿]|[^\W_一-鿿]+|\n+|[^\w\s]|_")
_mark = re.compile(r"\s*(?:…+|\.{3}|\[[a-z]{2,12}\]|\([a-z]{2,12}\)|--[a-z ]{3,30}--)$")
_debris = re.compile(r"(?:�+|&(?:[a-z]{1,6}|#\d*)|</?[a-z]{0,5}|\\(?:u[0-9a-fA-F]{0,3})?)$")
_closers = "'\"”’)）»」"
_item = re.compile(r"\s*(?:[-*•]|\d+[.)]|\w+ \d+[.)])\s")
_rule = re.compile(r"[|\s:-]+")
_sentence = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
_hex = re.compile(r"[0-9a-f]+")
END = set(".!?。！？")
OTHER, BREAK, HAN, WORD, MIXED, NUMBER = range(6)
#: Bits of the filter that keeps only n-grams some text ends with; 2 MB.
FILTER_BITS = 24
#: Occurrences that a context needs to be judged by.
SUPPORT = 5
#: What each kind of evidence adds; a text is cut at 1 or more. The trie of words
#: (``word``) and a context that hardly ever ends anything (``inside``) do alone,
#: as does a cutting program's mark. An open structure, debris, prose before the
#: end, a length at which its source piles up and a larger declared length need a
#: context that doesn't end there, or that the corpus does not know. A closing
#: phrase outweighs all but a word cut short or a bracketed mark inside a line.
WEIGHTS = {
    "word": 4.0, "closer": -2.0, "inside": 1.0, "seldom": 0.5, "often": 0.3, "always": -0.5, "unknown": 0.35,
    "bracket": 2.5, "mark": 1.5, "structure": 0.7, "debris": 0.7, "prose": 0.7, "piled": 1.0, "more": 0.65,
}
#: Shares of a context's occurrences that end something, up to which it is inside, seldom and often an end.
INSIDE, SELDOM, OFTEN = 0.04, 0.5, 0.9


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


class _Classes(dict):
    """Number of every token met, with what is known of it by number."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []
        self.words: list[str] = []
        self.table = np.empty((0, 3), np.uint64)

    def __missing__(self, t: str) -> int:
        word = ""
        if t[0] == "\n":
            name = shape = "\n"
            kind = BREAK
        elif t.isdigit():
            if t != "9":
                return self["9"]  # numbers are endless, so only one is kept
            name = shape = "9"
            kind = NUMBER
        elif len(t) == 1 and "一" <= t <= "鿿":
            name, shape, kind = t, "Z", HAN
        elif t.isalpha():
            name = word = t.lower()
            shape, kind = "W", WORD
        elif t.isalnum():
            like = "0" + "x" * (min(len(t), 40) - 1)
            if t != like:
                return self[like]  # as are hashes
            name = shape = f"x{len(t)}"
            word, kind = "#" * len(t), MIXED
        else:
            name = shape = t
            kind = BREAK if t in END else OTHER
        self.words.append(word)
        self.rows.append((_hash(name), _hash(shape + "\0"), kind))
        self[t] = n = len(self.rows) - 1
        return n

    def known(self) -> np.ndarray:
        """Hash, shape hash and kind by number."""
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64).reshape(-1, 3)])
        return self.table


_classes = _Classes()


def _word(number: int) -> str:
    return _classes.words[number]


def _mix(seed: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        for p in parts:
            h = (h ^ p) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    return h


def _contexts(h: np.ndarray, s: np.ndarray, kind: np.ndarray, place: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length, most specific first: positions and context hashes."""
    out = []
    for seed, back, last, mask in ((4, 3, h, kind[at] == HAN), (3, 2, h, True), (13, 2, s, True), (2, 1, h, True), (12, 1, s, True), (1, 0, h, True)):
        i = at[(place[at] >= back) & mask]
        out.append((i, _mix(seed, *(h[i - b] for b in range(back, 0, -1)), last[i])))
    return out


LEVELS = 6


def _arrays(texts: list[list[str]]) -> tuple[np.ndarray, ...]:
    """Hashes, shapes, kinds, word numbers, place in the text and text number of all tokens."""
    global _classes
    if len(_classes) > 300_000:
        _classes = _Classes()
    lengths = np.array([len(t) for t in texts], np.int64)
    number = np.fromiter(map(_classes.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    known = _classes.known()[number]
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return known[:, 0], known[:, 1], known[:, 2].astype(np.int64), number, place, doc


def _body(text: str) -> tuple[str, str, bool]:
    """The text without the mark at its end, the mark, and whether debris follows."""
    t = text.rstrip()
    m = _mark.search(t, max(0, len(t) - 60))  # a mark is shorter
    mark = m.group(0).strip() if m else ""
    t = t[: m.start()].rstrip() if m else t
    bare = t.rstrip("\ufffd")
    if len(bare) < len(t):
        return bare.rstrip(), mark, True
    d = _debris.search(t, max(0, len(t) - 20))  # as are broken entities and tags
    return (t[: d.start()].rstrip() if d else t), mark, bool(d)


def _lines_back(t: str) -> Iterator[str]:
    """Lines that aren't blank, stripped, the last one first."""
    end = len(t)
    while end >= 0:
        at = t.rfind("\n", 0, end)
        line = t[at + 1 : end].strip()
        if line:
            yield line
        end = at


def _tail_of(t: str, size: int, enough) -> str:
    """The least tail of doubling size that is enough, or the whole text."""
    while size < len(t) and not enough(t[-size:]):
        size *= 2
    return t[-size:]


def _term(text: str) -> bool:
    """Whether a text ends with a sentence, before closing quotes and brackets."""
    return text.rstrip(_closers)[-1:] in END


def _shape(line: str) -> tuple[list[str], list[str]]:
    tokens = _tok.findall(line)
    return tokens, ["A" if t[0].isalnum() else t for t in tokens]


def open_structure(text: str) -> str | None:
    """``open`` if a structure is unfinished at the end, ``closed`` if one ends there, else null."""
    t = text.strip()
    if t.count("```") % 2:
        return "open"
    if t.endswith("```"):
        return "closed"
    inner = t.strip("`").strip()
    inner = inner[4:].strip() if inner.startswith("json") else inner
    if inner.startswith("{"):
        return "open" if inner.count("{") != inner.count("}") else "closed"
    back = _lines_back(t)
    last = next(back, "")
    if last.startswith("|"):
        row = next((x for x in back if x.startswith("|")), None)
        whole = last.endswith("|") and (row is None or last.count("|") == row.count("|"))
        return "closed" if whole and not _rule.fullmatch(last) else "open"
    before = [x for x, _ in zip(back, range(6))][::-1]
    if len(before) >= 3 and not _item.match(last):
        tokens, shape = _shape(last)
        shapes = [_shape(x) for x in before]
        whole = max((s for _, s in shapes), key=lambda s: sum(s == u for _, u in shapes))
        same = [u for u, s in shapes if s == whole]
        if len(same) >= 3 and len(whole) > 4 and any(not x[0].isalnum() for x in whole[1:]) and not _term(before[-1]):
            if len(shape) < len(whole) and shape == whole[: len(shape)] and shape not in [s for _, s in shapes]:
                return "open"
            if shape == whole and tokens:
                ends = [u[-1] for u in same]
                w = len(ends[0])
                if all(len(e) == w and _hex.fullmatch(e) for e in ends) and any(c.isdigit() for e in ends for c in e) and len(tokens[-1]) < w:
                    return "open"
                if all(e[0].isdigit() and e[-1].isalpha() and not _hex.fullmatch(e) for e in ends) and not (tokens[-1][0].isdigit() and tokens[-1][-2:] == ends[0][-2:]):
                    return "open"
                if all(len(e) == w for e in ends) and len(tokens[-1]) == w:
                    return "closed"
    return None


def _after_sentence(t: str) -> bool:
    """Whether the part before the last one, of sentences and lines, is a whole sentence."""
    split = lambda x: [y for y in _sentence.split(x) if y and y.strip()]
    parts = split(_tail_of(t, 1500, lambda x: len(split(x)) > 2))
    return len(parts) > 1 and _term(parts[-2].strip())


def tails(documents: DataFrame) -> DataFrame:
    """What the end of each text shows by itself; null and blank texts drop out."""
    rows = documents.select("doc_id", clean_name(F.col("source")).alias("source"), F.col("n_chars").cast("bigint").alias("declared"), "text")
    rows = rows.where("doc_id is not null and text is not null")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ends: list[list[str]] = []
            for i, src, said, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "declared", "text"))):
                if not t.strip():
                    continue
                body, mark, debris = _body(t)
                r = t.rstrip()
                structure = open_structure(r) if not debris else None
                term = _term(r)
                asked = debris or structure == "open" or (structure is None and (not term or mark != ""))
                # six tokens, the first of which may be a part
                ends.append(_tok.findall(_tail_of(body, 300, lambda x: len(_tok.findall(x)) > 6))[-5:] if asked else [])
                size, octets = len(t), len(t.encode("utf-8", "surrogatepass"))
                line = r[r.rfind("\n") + 1 :]
                item = bool(_item.match(line))
                prose = asked and not item and _after_sentence(r)
                more = said is not None and said > size + max(3, size // 50) and said != octets
                out.append((i, src, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63, size, octets, debris, structure, term, mark, item, prose, more))
            h, s, kind, word, place, doc = _arrays(ends)
            last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else np.empty(0, np.int64)
            grams: list[list[int | None]] = [[None] * LEVELS for _ in ends]
            for level, (i, g) in enumerate(_contexts(h, s, kind, place, last)):
                for d, v in zip(doc[i].tolist(), g.astype(np.int64).tolist()):
                    grams[d][level] = v
            words: list[str | None] = [None] * len(ends)
            for d, w in zip(doc[last].tolist(), word[last].tolist()):
                words[d] = _word(w) or None
            a = list(zip(*out)) if out else [[]] * 12
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(a, types)), pa.array(words, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=names)

    names = ["doc_id", "source", "text_hash", "size", "octets", "debris", "structure", "term", "mark", "item", "prose", "more", "word", "grams"]
    return rows.mapInArrow(look, "doc_id bigint, source string, text_hash bigint, size bigint, octets bigint, debris boolean, structure string, term boolean, mark string, item boolean, prose boolean, more boolean, word string, grams array<bigint>")


def corpus_counts(documents: DataFrame, open_ends: DataFrame) -> DataFrame:
    """``gram, word, n, n_end``: contexts some text ends with, and all words, over all texts.

    The last token of every text is left out. Either ``gram`` or ``word`` is set.
    """
    spark = documents.sparkSession

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            g = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            on[g & ((1 << FILTER_BITS) - 1)] = True
        yield chunks(np.packbits(on))

    packed = summed(open_ends.select(F.explode("grams").alias("g")).mapInArrow(mark, "chunk int, part binary"), FILTER_BITS - 3, "u1", np.bitwise_or)
    wide = spark.sparkContext.broadcast(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(wide.value).astype(bool)
        grams: list[np.ndarray] = []
        held = 0
        words: dict[str, int] = {}

        def packed_counts() -> pa.RecordBatch:
            g, inv = np.unique(np.concatenate([x[0] for x in grams]) if grams else np.empty(0, np.uint64), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([x[1] for x in grams]) if grams else None, minlength=len(g)).astype(np.int64)
            e = np.bincount(inv, weights=np.concatenate([x[2] for x in grams]) if grams else None, minlength=len(g)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.nulls(len(g), pa.string()), pa.array(n), pa.array(e)], names=["gram", "word", "n", "n_end"])

        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 500):
                h, s, kind, word, place, doc = _arrays([_tok.findall(_body(t)[0]) for t in texts[lo : lo + 500]])
                if not len(h):
                    continue
                end_of_text = np.r_[doc[1:] != doc[:-1], True]
                after = np.r_[kind[1:] == BREAK, False]
                at = np.flatnonzero(~end_of_text & (kind != BREAK))
                for i, g in _contexts(h, s, kind, place, at):
                    k = on[(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                    u, inv = np.unique(g[k], return_inverse=True)
                    n = np.bincount(inv, minlength=len(u))
                    grams.append((u, n, np.bincount(inv, weights=after[i[k]], minlength=len(u))))
                    held += len(u)
                own = np.bincount(word[at[(kind[at] == WORD) | (kind[at] == MIXED)]], minlength=1)
                for w in np.flatnonzero(own).tolist():
                    words[_word(w)] = words.get(_word(w), 0) + int(own[w])
                if held > 3_000_000:
                    yield packed_counts()
                    grams, held = [], 0
        yield packed_counts()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.array([0] * len(words), pa.int64())], names=["gram", "word", "n", "n_end"])

    rows = documents.select("text").where("text is not null").mapInArrow(count, "gram bigint, word string, n bigint, n_end bigint")
    return rows.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def trie(words: DataFrame) -> DataFrame:
    """``node, below``: every proper prefix of a word, and how often longer words occur below it."""
    nodes = words.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("node"), "n")
    return nodes.groupBy("node").agg(F.sum("n").alias("below"))


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, source, reason, evidence`` of every text that isn't blank; ``reason`` is null for whole texts.

    Every kind of evidence adds to a score (``WEIGHTS``). Reasons tell where a text
    stops: ``debris`` (a broken character, entity, tag or escape), ``structure``
    (an unfinished object, fence, table or log line), ``mark`` (a cutting
    program's mark), ``word`` (inside a word), ``sentence`` (inside a sentence) and
    ``length`` (an unfinished end where the source piles up, or where more was
    declared). ``evidence`` tells what the corpus knows of the end: ``word`` (an
    unknown prefix of known words in the trie), ``context`` (one that does not end
    there), ``length``, ``unknown context``, or ``mark`` alone. Rows with null ids drop out; copies
    of a text are judged alike; an empty table gives an empty result.
    """
    ends = written(tails(documents), "tails")
    asked = "debris or structure = 'open' or (structure is null and (not term or mark <> ''))"
    doubtful = ends.where(f"coalesce({asked}, false)")
    counts = written(corpus_counts(documents, doubtful), "counts")
    context = counts.where("gram is not null").select(F.col("gram").alias("g"), F.col("n").alias("t"), "n_end")
    single = F.col("level") == LEVELS - 1
    # how many different texts end with a context
    final = doubtful.dropDuplicates(["text_hash"]).select(F.explode("grams").alias("g")).where("g is not null").groupBy("g").agg(F.count("*").alias("f"))
    each = doubtful.select("doc_id", F.posexplode("grams").alias("level", "g")).where("g is not null")
    each = each.join(final, "g").join(context, "g", "left").na.fill(0, ["t", "n_end"])

    words = counts.where("word is not null").select("word", F.col("n").alias("n_word"))
    nodes = trie(words.select("word", F.col("n_word").alias("n"))).withColumnRenamed("node", "word")
    asked_words = doubtful.select("word").where("word is not null").distinct()
    looked = asked_words.join(words, "word", "left").join(nodes, "word", "left").na.fill(0, ["n_word", "below"])
    # an unknown, or all but unknown, proper prefix of known words, that few texts end with
    prefix = (F.col("below") >= 2) & (F.col("n_word") <= F.col("below") / 1000) & (F.col("f_word") <= 3 + F.col("below") / 20)
    ended = each.where(single).groupBy("doc_id").agg(F.max("f").alias("f_word"))
    known = written(doubtful.select("doc_id", "text_hash", "word").join(looked, "word", "left").join(ended, "doc_id", "left").select("doc_id", "text_hash", F.coalesce(prefix, F.lit(False)).alias("prefix")), "words")
    # cuts inside words tell how often a random cut falls on a place: three times that is no chance
    cuts = known.where("prefix").agg(F.countDistinct("text_hash").alias("cuts")).join(words.agg(F.sum("n_word").alias("places")))
    rate = cuts.select((3 * F.col("cuts") / F.greatest(F.coalesce("places", F.lit(0)), F.lit(1))).alias("rate"))

    others = F.col("f") - 1
    at = lambda k: F.coalesce(F.max(F.when(F.col("level") == k, F.col("t"))), F.lit(0))
    per = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("level", "t", "n_end", others.alias("o")))).alias("c"), at(2).alias("long"), at(4).alias("short"))
    per = per.join(F.broadcast(rate))

    def closing(x: Column) -> Column:
        """A closing phrase ends far more texts than random cuts would at places of its shape."""
        shape = F.when(x["level"] <= 1, F.col("long")).when(x["level"] == 3, F.col("short")).otherwise(x["t"])
        return (x["level"] < LEVELS - 1) & (x["o"] > F.col("rate") * shape) & (x["o"] >= F.when(x["level"] <= 3, 1).otherwise(2)) & (x["o"] > x["t"])

    first = lambda keep: F.get(F.filter("c", keep), F.lit(0))
    per = per.withColumn("closing", first(closing)).withColumn("x", F.coalesce("closing", first(lambda x: x["t"] >= SUPPORT))).where("x is not null")
    total = F.col("x.t") + F.col("x.o")
    best = per.select("doc_id", ((F.col("x.n_end") + F.col("x.o")) / total).alias("line_ends"), (F.col("x.o") / total).alias("text_ends"), F.col("closing").isNotNull().alias("closer"))

    # lengths at which a source piles up, by characters or bytes
    sizes = ends.dropDuplicates(["text_hash"]).select("source", F.explode(F.array_distinct(F.array("size", "octets"))).alias("size"))
    sizes = sizes.groupBy("source", "size").agg(F.count("*").alias("k"))
    texts = ends.groupBy(F.col("source").alias("ps")).agg(F.count("*").alias("texts"))
    piles = sizes.join(texts, F.col("source").eqNullSafe(F.col("ps"))).where("k >= 8 and k >= 0.02 * texts")
    piles = piles.select("ps", F.col("size").alias("limit"))

    r = doubtful.join(best, "doc_id", "left").join(known.select("doc_id", "prefix"), "doc_id", "left")
    hit = r.join(piles, F.col("source").eqNullSafe(F.col("ps")) & ((F.col("size") == F.col("limit")) | (F.col("octets") == F.col("limit"))), "left_semi").select("doc_id", F.lit(True).alias("piled")).distinct()
    r = r.join(hit, "doc_id", "left").withColumn("piled", F.coalesce("piled", F.lit(False)) & ~F.col("item"))
    r = r.withColumn("open", F.coalesce(F.col("structure") == "open", F.lit(False))).withColumn("more", F.col("more") & ~F.col("item"))
    # inside structures a line's end is no end
    share = F.when(F.col("open") | F.col("debris"), F.col("text_ends")).otherwise(F.col("line_ends"))
    r = r.withColumn("share", share).withColumn("known_prose", F.col("prose") & F.col("share").isNotNull())
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    bracket = F.col("mark").rlike(r"^(\[|\(|--)")
    parts = [
        F.when(F.col("prefix"), w["word"]), F.when(F.col("closer"), w["closer"]),
        F.when(F.col("share").isNull(), w["unknown"]).when(F.col("share") < INSIDE, w["inside"]).when(F.col("share") < SELDOM, w["seldom"]).when(F.col("share") < OFTEN, w["often"]).otherwise(w["always"]),
        F.when(bracket, w["bracket"]).when(F.col("mark") != "", w["mark"]), F.when(F.col("open"), w["structure"]), F.when(F.col("debris"), w["debris"]),
        F.when(F.col("known_prose"), w["prose"]), F.when(F.col("piled"), w["piled"]), F.when(F.col("more"), w["more"]),
    ]
    score = sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0))
    reason = (
        F.when(F.col("debris"), "debris").when(F.col("open"), "structure").when(bracket, "mark").when(F.col("prefix"), "word").when(F.col("mark") != "", "mark")
        .when((F.col("share") < INSIDE) | F.col("known_prose"), "sentence").otherwise("length")
    )
    evidence = F.when(F.col("prefix"), "word").when(F.col("share") < OFTEN, "context").when(F.col("piled") | F.col("more"), "length").when(F.col("share").isNull(), "unknown context").otherwise("mark")
    cut = F.round(score, 6) >= 1
    found = r.select("doc_id", "source", F.when(cut, reason).alias("reason"), F.when(cut, evidence).alias("evidence"))
    none = F.lit(None).cast("string")
    return ends.where(f"not coalesce({asked}, false)").select("doc_id", "source", none.alias("reason"), none.alias("evidence")).unionByName(found).dropDuplicates(["doc_id"])


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id, source, reason, evidence`` of the cut texts."""
    return judged(documents).where("reason is not null")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: ``n_documents`` that aren't blank, ``n_truncated`` and their ``rate``."""
    out = judged(documents).groupBy("source").agg(F.count("*").alias("n_documents"), F.count("reason").alias("n_truncated"))
    return out.withColumn("rate", F.round(F.col("n_truncated") / F.col("n_documents"), 6))
