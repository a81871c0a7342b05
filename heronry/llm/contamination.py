"""Evaluation texts leaking into training text, by latent semantic retrieval.

1. One pass reads the corpus: every text is brought to the words of the evaluation texts, as numbers, and what the corpus
   says of these words is counted. Word sequences common to several items and many different texts are stock phrases.
2. The evaluation texts, without stock phrases, are cut into passages of WINDOW words; their TF-IDF matrix is
   factorised by a distributed randomised SVD (subspace iteration whose products are summed over partitions).
3. Every document is cut into passages likewise, each projected to the latent space and compared by cosine with all
   evaluation passages as one matrix product; near ones are candidates. The latent space blurs short passages among many
   items, so whatever shares LINKS or more sequences of GRAM words with an item is a candidate as well: 20 words of which
   two were replaced share at least that many, so this part is exact at any number of items.
4. A candidate counts if the longest common subsequence of its words and the item's, in runs that only light edits
   interrupt, has enough words, and enough words that are the item's own (no stock): the answer must be there.

Texts are read and normalised once, whatever the number of items; a document's passages never leave its task. The words
of all evaluation texts, their sequences and the latent space go to the workers; they are bounded by the evaluation
texts. Passages go there in blocks of BLOCK items, which bounds memory and changes no row: everything that decides on a
row is worked out over all items.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import materialise

#: Words of a passage; documents are cut every HALF words, evaluation texts every STEP.
WINDOW, HALF, STEP = 24, 12, 8
#: Dimensions of the latent space, more that the sketch takes, rounds of the subspace iteration, and its seed.
RANK, OVERSAMPLING, ROUNDS, SEED = 96, 16, 3, 20_240_601
#: Cosine from which passages are candidates.
COSINE = 0.7
#: Words of a sequence, and the sequences in common with an item from which a text is a candidate without a look at the latent space.
GRAM, LINKS = 6, 3
#: A sequence is stock if at least STOCK_ITEMS items have it and STOCK_SHARE of the different texts of some source, at least STOCK_LEAST.
STOCK_ITEMS, STOCK_SHARE, STOCK_LEAST = 2, 0.01, 5
#: Longest common subsequence that a passage of a document must have with the item before the two are compared in full.
COMMON = 11
#: A leak: common words in order, how many of them no stock phrase has, and their share of the item's span; a stock sentence with a few words about it has a smaller share.
MATCHED, OWN, TIGHT = 16, 9, 0.85
#: Or so many words that no stock phrase has and a smaller share; and the words that edits may replace in one place.
SURE, DENSITY, GAP = 15, 0.7, 4
#: Evaluation items whose passages a task holds at a time.
BLOCK = 4000

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|sup|sub|code|a|font|mark|small|tt)(?:\s[^<>]*)?>", re.I)
_BLOCK_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_STYLE = re.compile(r"\\(?:emph|underline|mbox|textit|textbf|textsc|texttt|textrm|textsf|textsl|text|mathrm|mathbf|mathit)\s*\{")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=\w)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e]+")
#: Combining marks that accents are decomposed to.
_ACCENT = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def plain(text: str) -> str:
    """Lower-case text without markup, character encodings, accents, invisible characters and broken words."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\u" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), t)
    if "%" in t and len(_PERCENT.findall(t)) > 2:
        t = urllib.parse.unquote(t, errors="ignore")
    if "<" in t:
        t = _BLOCK_TAG.sub(" ", _TAG.sub("", t))
    if not t.isascii():
        t = _ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", t)))
    if "-\n" in t or "- \n" in t or "-\r" in t:
        t = _BROKEN.sub("", t)
    if "\\" in t:
        t = _STYLE.sub(" ", t)
    return t.lower()


def words(text: str | None) -> list[str]:
    """Words of a text whatever its case, spacing, punctuation, markup or encoding; none for null."""
    return _WORD.findall(plain(text)) if text else []


class Vocabulary:
    """Words of the evaluation texts and what the corpus says of them; sent to the workers."""

    def __init__(self, texts: dict[int, list[str]]) -> None:
        self.number = {w: i for i, w in enumerate(sorted({w for ws in texts.values() for w in ws}))}
        self.size = len(self.number)
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(1, 2**63, GRAM, dtype=np.uint64) | np.uint64(1)
        #: Sequences of at least STOCK_ITEMS items: what only one item has is no stock, however many texts it leaked to.
        each = [np.unique(self.grams(self.ids(ws))) for ws in texts.values()]
        grams, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.known = grams[n >= STOCK_ITEMS]
        self.stock = np.zeros(0, np.uint64)
        self.idf = np.ones(self.size, np.float32)
        #: What a text is stored as: numbers of words, ``size`` for any other word.
        self.kind = np.uint16 if self.size < 65_000 else np.uint32

    def ids(self, ws: list[str]) -> np.ndarray:
        get, none = self.number.get, self.size
        return np.array([get(w, none) for w in ws], np.int32) if ws else np.zeros(0, np.int32)

    def flat(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Several texts in one array, a separator after each, and where each begins."""
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
        out = np.full(starts[-1], self.size + 1, np.int32)
        for a, t in zip(starts, texts):
            out[a : a + len(t)] = t
        return out, starts

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Hash of every sequence of GRAM words by where it begins."""
        n = len(ids) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        wide = ids.astype(np.uint64) + np.uint64(1)
        h = wide[:n] * self.odd[0]
        for j in range(1, GRAM):
            h ^= (h >> np.uint64(29)) + wide[j : n + j] * self.odd[j]
            h *= self.odd[0]
        return h

    def among(self, h: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Positions of hashes in a sorted table, -1 for none."""
        if not len(table) or not len(h):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[at] == h, at, -1)

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Mask of the words that are in no stock sequence."""
        keep = np.ones(len(ids), bool)
        for at in np.nonzero(self.among(self.grams(ids), self.stock) >= 0)[0]:
            keep[at : at + GRAM] = False
        return keep


READ_SCHEMA = "kind string, key bigint, n bigint, source string, text bigint, ids binary"


def read(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """What the corpus says, in one pass: rows of documents (``d``), of sequences in them (``g``) and of words (``w``).

    ``docs`` has doc_id, text and source. A document's row has its words as numbers; it is left out if too few are words
    of the evaluation texts. Sequences of several items have a row per document, -1 stands for the document itself; words
    are counted within a task.
    """
    own_words = np.dtype(voc.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("source", pa.string()), ("text", pa.int64()), ("ids", pa.binary())])
        df = np.zeros(voc.size + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                keys, texts, sources = (b.column(c).slice(lo, 64).to_pylist() for c in range(3))
                held = [voc.ids(words(t)) for t in texts]
                flat, starts = voc.flat(held)
                known = voc.among(voc.grams(flat), voc.known)
                out: list[tuple] = []
                for n, (t, ids) in enumerate(zip(texts, held)):
                    df[np.unique(ids)] += 1
                    digest = int.from_bytes(hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    at = np.unique(known[starts[n] : starts[n + 1] - 1])
                    out += [("g", k, 0, sources[n], digest, None) for k in (-1, *at[at >= 0].tolist())]
                    if np.count_nonzero(ids < voc.size) >= OWN:
                        out.append(("d", keys[n], 0, None, 0, ids.astype(own_words).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        some = np.nonzero(df[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(["w"] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(df[some], pa.int64()), *(pa.nulls(len(some), f.type) for f in list(schema)[3:])], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit(""))).mapInArrow(run, READ_SCHEMA)


def statistics(seen: DataFrame, voc: Vocabulary) -> Vocabulary:
    """Fills in idf and stock sequences from all rows of ``read``.

    In how many different texts of a source a sequence stands is counted exactly, copies of one text once. What comes
    back is at most a row per word and sequence of the evaluation texts.
    """
    per_source = seen.filter("kind = 'g'").select("key", "source", "text").distinct().groupBy("key", "source").agg(F.count("*").alias("texts"))
    per_source = materialise(per_source)  # counted once, wanted twice
    all_sources = per_source.groupBy("key").agg(F.sum("texts").alias("texts")).select("key", F.lit(None).cast("string").alias("source"), "texts")
    counted = per_source.unionByName(all_sources)
    of = counted.filter("key = -1").select(F.col("source").alias("_s"), F.col("texts").alias("_all"))
    often = counted.filter("key >= 0").join(of, F.col("source").eqNullSafe(F.col("_s")))
    stock = often.filter((F.col("texts") >= STOCK_LEAST) & (F.col("texts") >= STOCK_SHARE * F.col("_all"))).select("key").distinct().toPandas()
    voc.stock = np.sort(voc.known[stock.key.to_numpy(np.int64)])
    ws = seen.filter("kind = 'w'").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    n_docs = seen.filter("kind = 'g' and key = -1").count()
    df = np.zeros(voc.size)
    df[ws.key.to_numpy(np.int64)] = ws.n.to_numpy(np.float64)
    voc.idf = np.log((n_docs + 1) / (df + 1) + 1).astype(np.float32)
    return voc


def _passages(ids: np.ndarray) -> list[np.ndarray]:
    last = max(0, len(ids) - WINDOW)
    return [ids[a : a + WINDOW] for a in sorted({*range(0, last + 1, STEP), last})] if len(ids) else []


def _weights(ids: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = np.unique(ids[ids < voc.size], return_counts=True)
    w = tf * voc.idf[terms].astype(np.float64)
    return terms, w / max(np.linalg.norm(w), 1e-12)


def latent_space(items: DataFrame, voc: Vocabulary) -> np.ndarray:
    """Right singular vectors (words x RANK) of the TF-IDF matrix of the evaluation passages, by randomised SVD.

    Each round multiplies the sketch by the Gram matrix: tasks multiply the rows they hold and the parts are summed by
    word in Spark; only the sketch, words x (RANK + OVERSAMPLING), is orthonormalised on the driver.
    """
    k = min(RANK + OVERSAMPLING, voc.size)

    def product(sketch: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros_like(sketch)
            for b in batches:
                for t in b["item_text"]:
                    ids = voc.ids(words(t))
                    for p in _passages(ids[voc.own(ids)]):
                        terms, w = _weights(p, voc)
                        out[terms] += np.outer(w, w @ sketch[terms])
            some = np.nonzero(np.abs(out).sum(axis=1))[0]
            yield pd.DataFrame({"term": some, "v": list(out[some])})

        parts = items.select("item_text").mapInPandas(part, "term bigint, v array<double>")
        sums = parts.groupBy("term").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(k)]).alias("v")).toPandas()
        total = np.zeros_like(sketch)
        if len(sums):
            total[sums.term.to_numpy(np.int64)] = np.vstack(sums.v)
        return total

    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((voc.size, k)))
    for _ in range(ROUNDS - 1):
        q, _ = np.linalg.qr(product(q))
    z = product(q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return q @ vectors[:, np.argsort(-values)[: min(RANK, k)]]


def masks(item: np.ndarray) -> dict[int, int]:
    """Bit sets of the places at which each word stands."""
    out: dict[int, int] = {}
    for n, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | (1 << n)
    return out


def common(passage: list[int], at: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of a passage and an item, all the item's places at a time."""
    full = (1 << length) - 1
    s = full
    for w in passage:
        m = at.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def leaked(compare: SequenceMatcher, doc: np.ndarray, own: np.ndarray) -> bool:
    """Whether a stretch of a document has a run of words in common with an item that is long and dense enough.

    ``compare`` holds the item, ``own`` how many of its first n words are in no stock phrase. The longest common blocks
    are found first and then those between them; blocks with at most GAP other words between them on either side are
    one run. Of the run MATCHED words must be in common, OWN of them no stock, or SURE that are no stock.
    """
    compare.set_seq1(doc.tolist())
    run, mine, start, end_d, end_i = 0, 0, 0, 0, 0
    for a, b, n in compare.get_matching_blocks():
        if not n:
            continue
        if run and (a - end_d > GAP or b - end_i > GAP):
            run = mine = 0
        if not run:
            start = b
        run, mine, end_d, end_i = run + n, mine + int(own[b + n] - own[b]), a + n, b + n
        span = end_i - start
        if (mine >= SURE and run >= DENSITY * span) or (run >= MATCHED and mine >= OWN and run >= TIGHT * span):
            return True
    return False


class Searcher:
    """Passages and sequences of a block of evaluation items; sent to the workers."""

    def __init__(self, texts: dict[int, list[str]], voc: Vocabulary, space: np.ndarray) -> None:
        self.voc = voc
        self.names: list[int] = []
        self.items: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        rows, owner, grams, of = [], [], [], []
        for i, ws in texts.items():
            ids = voc.ids(ws)
            own = voc.own(ids)
            for p in _passages(ids[own]):
                terms, w = _weights(p, voc)
                rows.append(w @ space[terms])
                owner.append(len(self.items))
            one = np.unique(voc.grams(ids))
            grams.append(one[voc.among(one, voc.stock) < 0])
            of.append(np.full(len(grams[-1]), len(self.items), np.int32))
            self.names.append(i)
            self.items.append(ids)
            self.own.append(own)
        self.masks = [masks(ids[own]) for ids, own in zip(self.items, self.own)]
        z = np.array(rows, np.float32).reshape(len(rows), space.shape[1])
        self.latent = np.ascontiguousarray((z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).T)
        self.owner = np.array(owner, np.int64)
        self.project = np.vstack([space * voc.idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        #: The items of each sequence: ``holders[first[k]:first[k + 1]]`` of ``table[k]``.
        every, holders = (np.concatenate(grams), np.concatenate(of)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        order = np.argsort(every, kind="stable")
        self.holders = holders[order]
        self.table, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.ready: dict[int, tuple[SequenceMatcher, np.ndarray]] = {}

    def compare(self, i: int) -> tuple[SequenceMatcher, np.ndarray]:
        """What ``leaked`` wants of an item, made when it is first wanted."""
        if i not in self.ready:
            self.ready[i] = SequenceMatcher(None, "", self.items[i].tolist(), autojunk=False), np.concatenate([[0], np.cumsum(self.own[i])])
        return self.ready[i]

    def linked(self, flat: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> where the text has sequences of the item, if they are LINKS at least."""
        hit = self.voc.among(self.voc.grams(flat), self.table)
        at = np.nonzero(hit >= 0)[0]
        n = self.first[hit[at] + 1] - self.first[hit[at]]
        each = np.repeat(at, n)
        item = self.holders[np.repeat(self.first[hit[at]] - np.concatenate([[0], np.cumsum(n)[:-1]]) , n) + np.arange(len(each))] if len(at) else np.zeros(0, np.int32)
        text = np.searchsorted(starts, each, "right") - 1
        pair = text * len(self.items) + item
        order = np.argsort(pair, kind="stable")
        _, first, count = np.unique(pair[order], return_index=True, return_counts=True)
        out = {}
        for a, c in zip(first.tolist(), count.tolist()):
            if c >= LINKS:
                o = order[a : a + c]
                out[int(text[o[0]]), int(item[o[0]])] = (each[o] - starts[text[o[0]]]).tolist()
        return out

    def near(self, held: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> passages of the text that are near one of the item in the latent space; ``held`` are own words."""
        rows, where = [], []
        for n, ids in enumerate(held):
            # Words that no evaluation text has add nothing; a text with too few others cannot hold a passage.
            if np.count_nonzero(ids < self.voc.size) < COMMON:
                continue
            # Latent sums of each HALF words of a text; a passage is two that follow one another.
            s = np.add.reduceat(self.project[ids], np.arange(0, len(ids), HALF), axis=0)
            s = s[:-1] + s[1:] if len(s) > 1 else s
            rows.append(s)
            where += [(n, j) for j in range(len(s))]
        out: dict[tuple[int, int], list[int]] = {}
        if not rows or not self.latent.shape[1]:
            return out
        z = np.vstack(rows)
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        for a in range(0, len(z), 1024):
            cos = z[a : a + 1024] @ self.latent
            for r in np.nonzero(cos.max(axis=1) >= COSINE)[0]:
                n, j = where[a + r]
                for i in set(self.owner[cos[r] >= COSINE].tolist()):
                    if common(held[n][j * HALF : j * HALF + WINDOW].tolist(), self.masks[i], int(self.own[i].sum())) >= COMMON:
                        out.setdefault((n, i), []).append(j)
        return out

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int]]:
        """(position of the text, item) of every leak in a few texts, each given as numbers of words."""
        flat, starts = self.voc.flat(texts)
        mask = self.voc.own(flat)
        own = [np.nonzero(mask[a : b - 1])[0] for a, b in zip(starts, starts[1:])]
        places = self.linked(flat, starts)
        for (n, i), js in self.near([t[o] for t, o in zip(texts, own)]).items():
            spots = own[n]
            places.setdefault((n, i), []).extend(int(spots[min(k, len(spots) - 1)]) for j in js for k in (j * HALF, j * HALF + WINDOW - 1))
        out = []
        for (n, i), at in sorted(places.items()):
            compare, mine = self.compare(i)
            if any(leaked(compare, texts[n][max(0, a - WINDOW) : b + GRAM + WINDOW], mine) for a, b in _stretches(at)):
                out.append((n, self.names[i]))
        return out


def _stretches(at: list[int]) -> list[tuple[int, int]]:
    """Places near one another joined, so that each stretch of a text is compared once."""
    out: list[list[int]] = []
    for j in sorted(at):
        if out and j - out[-1][1] <= 2 * WINDOW:
            out[-1][1] = j
        else:
            out.append([j, j])
    return [(a, b) for a, b in out]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document and evaluation item of which it holds a passage, each once per document row.

    ``docs`` has doc_id, text and, if there is one, source; ``items`` item_id and item_text. Null and empty texts leak
    nothing, nor do items with fewer than OWN words of their own; repeated document rows are answered each. Whole texts
    are searched.
    """
    source = F.col("source") if "source" in docs.columns else F.lit("")
    docs, items = docs.select("doc_id", "text", source.alias("source")), items.select("item_id", "item_text").filter("item_id is not null and item_text is not null").dropDuplicates(["item_id"])
    texts = {r.item_id: words(r.item_text) for r in items.collect()}
    voc = Vocabulary(texts)
    if not voc.size:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    seen = materialise(read(docs, voc))
    voc = statistics(seen, voc)
    space = latent_space(items, voc)
    held = seen.filter("kind = 'd'").select("key", "ids")
    names = sorted(texts)
    found = None
    for a in range(0, len(names), BLOCK):
        one = Searcher({i: texts[i] for i in names[a : a + BLOCK]}, voc, space)

        def run(batches: Iterator[pa.RecordBatch], one: Searcher = one) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, kept = b.column(0), b.column(1)
                hits = []
                for a in range(0, b.num_rows, 64):
                    some = [np.frombuffer(x.as_buffer(), one.voc.kind).astype(np.int32) for x in kept.slice(a, 64)]
                    hits += [(a + n, i) for n, i in one.search(some)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([n for n, _ in hits], pa.int64())), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])

        got = held.mapInArrow(run, "doc_id bigint, item_id bigint")
        found = got if found is None else found.unionByName(got)
    return found
