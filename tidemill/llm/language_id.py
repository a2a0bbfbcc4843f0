"""Language ID by prediction by partial matching (operator 6).

Each language has a tree of byte contexts of up to ORDER bytes with frozen
counts; a context is in the tree if the sample shows it often enough, so its
depth varies. A byte is coded in the deepest context of the tree that the bytes
before it reach: by its share if that context has seen it, else by an escape to
the next shorter one (method C, with exclusion of what the longer one has seen),
down to equal shares of all 256 bytes. As nothing is updated while scoring, the
escape of a context and the code length of a byte seen in it are fixed numbers,
and a text's exact code length is a sum of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

#: Labelled documents per language that the trees are grown on, at most (the fit's documented bound), and the groups they are drawn from evenly.
SAMPLE_PER_LANG, SALTS = 600, 120
#: Bytes of the texts of a language that are drawn, at most; a text over a group's share of them is left out.
BYTES_PER_LANG = 64 << 20
#: Longest context in bytes, and the occurrences from which on a context longer than two bytes is in the tree.
ORDER, SEEN = 4, 2
#: Of the drawn documents, one in so many is kept out of the trees to learn each language's usual code length from.
CALIBRATE = 6
#: Bits by which a text of n bytes may exceed its language's limit, times the root of n: short texts vary more.
SHORT = 16.0
#: Bytes of all trees together, at most: what is broadcast. Beyond it each language keeps its most frequent grams, of at most GRAM_BYTES each (keys, code lengths and contexts of five orders).
MODEL_BYTES, GRAM_BYTES = 512 << 20, 160
#: Bytes of text that are scored at once, and code lengths that a worker remembers.
BLOCK, MEMO = 1 << 17, 1 << 22

_BITS = 9  # of a symbol: a byte + 1; 0 stands before the text's start


def held_out() -> Column:
    """True for documents whose crc32(doc_id as text) mod 3 is 1; null ids hash as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _grams(buf: np.ndarray, place: np.ndarray, first: int, last: int) -> np.ndarray:
    """For the bytes first..last - 1 of buf, each with the ORDER before it in its text as one number; place is the byte's number in its text."""
    low = max(0, first - ORDER)
    s = buf[low:last].astype(np.int64) + 1
    out = s[first - low :].copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(last - first, np.int64)
        have = min(len(s) - k, last - first) if len(s) > k else 0
        before[last - first - have :] = s[len(s) - k - have : len(s) - k]
        before[place[first:last] < k] = 0
        out |= before << (_BITS * k)
    return out


def _places(offsets: np.ndarray) -> np.ndarray:
    return np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], np.diff(offsets))


def _count(batches):
    for piece in tk.slices(batches, 2 * BLOCK):
        buf, offsets = tk.utf8(piece.column("text"))
        buf, place = tk.LOWER[buf], _places(offsets)
        langs = np.array(piece.column("lang").to_pylist(), object)
        owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
        grams = _grams(buf, place, 0, len(buf))
        for lang in dict.fromkeys(langs):
            gram, n = np.unique(grams[(langs == lang)[owner]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


class Tree:
    """One language: for each order k the sorted keys (context and byte) with their code lengths, and the sorted contexts with their escapes, in bits."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.keys, self.hit, self.contexts, self.escape = [], [], [], []
        below = lambda key: np.full(len(key), 1 / 256)  # noqa: E731  share of a key's byte one order lower
        for k in range(ORDER + 1):
            key, of = np.unique(gram & ((1 << _BITS * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(of, n, len(key)) if len(key) else np.zeros(0)
            context, of = np.unique(key >> _BITS, return_inverse=True)
            total = np.bincount(of, count, len(context)) if len(key) else np.zeros(0)
            if k > 2:
                kept = (total >= SEEN)[of] if len(key) else np.zeros(0, bool)
                key, count = key[kept], count[kept]
                context, of = np.unique(key >> _BITS, return_inverse=True)
                total = np.bincount(of, count, len(context)) if len(key) else np.zeros(0)
            kinds = np.bincount(of, minlength=len(context))
            share = count / (total + kinds)[of]
            rest = 1 - np.bincount(of, below(key), len(context))
            with np.errstate(divide="ignore"):
                self.escape.append((np.log2(np.maximum(rest, 1e-12)) - np.log2(kinds / (total + kinds))).astype(np.float32))
                self.hit.append((-np.log2(share)).astype(np.float32))
            self.keys.append(key)
            self.contexts.append(context)
            mask = (1 << _BITS * (k + 1)) - 1
            below = lambda key, known=key, share=share, mask=mask: share[np.searchsorted(known, key & mask)]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for group in (self.keys, self.hit, self.contexts, self.escape) for a in group)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            key = gram[open_] & ((1 << _BITS * (k + 1)) - 1)
            if len(self.keys[k]) and len(key):
                at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
                seen = self.keys[k][at] == key
                out[open_[seen]] += self.hit[k][at[seen]]
                key, open_ = key[~seen] >> _BITS, open_[~seen]
                at = np.minimum(np.searchsorted(self.contexts[k], key), len(self.contexts[k]) - 1)
                known = self.contexts[k][at] == key
                out[open_[known]] += self.escape[k][at[known]]
        out[open_] += 8
        return out


class Ppm:
    """The trees of all languages, by name, and for each the bits a byte beyond which a text is not in it."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[lang]) for lang in self.langs]
        self.limits = np.full(len(self.langs), np.inf)
        self.memo = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def _bits(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(gram) for t in self.trees], 1).astype(np.float32)

    def _remembered(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths (n, languages), most of them from a table of those met before."""
        if self.memo is None:
            slots = 1 << max(8, (MEMO // len(self.langs)).bit_length() - 1)
            self.memo = np.full(slots, -1, np.int64), np.zeros((slots, len(self.langs)), np.float32)
        known, bits = self.memo
        slot = ((gram.view(np.uint64) * np.uint64(tk._MUL)) >> np.uint64(65 - len(known).bit_length())).astype(np.int64)
        missed = np.flatnonzero(known[slot] != gram)
        new, of = np.unique(gram[missed], return_inverse=True)
        found = self._bits(new)
        out = bits[slot]
        out[missed] = found[of]
        place = np.empty(len(new), np.int64)
        place[of] = slot[missed]
        known[place], bits[place] = new, found
        last = known[place] == new  # of several in one slot, the one that stayed
        bits[place[last]] = found[last]
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in bits, by language; a block of text at a time."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a in range(0, len(buf), BLOCK):
            b = min(a + BLOCK, len(buf))
            low = max(0, a - ORDER)
            first, last = np.searchsorted(offsets, (low, b), "right") - 1  # the rows that hold these bytes
            cut = offsets[first : last + 2]
            place = np.arange(low, b) - np.repeat(cut[:-1], np.diff(np.clip(cut, low, b)))
            grams = _grams(tk.LOWER[buf[low:b]], place, a - low, b - low)
            out[first : first + len(cut) - 1] += tk.segment_sum(self._remembered(grams), np.clip(cut, a, b) - a)
        return out

    def calibrate(self, lang: list[str], per_byte: np.ndarray) -> None:
        """Learn from texts outside the trees: a language's limit lies midway between what its own texts take and what those of the others do."""
        for k, name in enumerate(self.langs):
            own = np.array([x == name for x in lang], bool)
            if own.any():
                foreign = np.median(per_byte[~own, k]) if not own.all() else 8.0
                self.limits[k] = (np.median(per_byte[own, k]) + foreign) / 2

    def known(self, best: np.ndarray, size: np.ndarray, per_byte: np.ndarray) -> np.ndarray:
        """Whether texts of ``size`` bytes are within the limit of their best language."""
        return per_byte <= self.limits[best] + SHORT / np.sqrt(np.maximum(size, 1))


def _measure(model):
    def run(batches):
        for piece in tk.slices(batches):
            buf, offsets = tk.utf8(piece.column("text"))
            size = np.maximum(np.diff(offsets), 1)
            per_byte = model.value.lengths(buf, offsets) / size[:, None]
            bounds = np.arange(len(size) + 1) * per_byte.shape[1]
            yield pa.RecordBatch.from_arrays([piece.column("lang").combine_chunks(), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(per_byte.ravel()))], names=["lang", "bits"])

    return run


def pruned(grams: DataFrame, size: int) -> DataFrame:
    """The most frequent grams (lang, gram, n) of each language, so that the trees of all take ``size`` bytes at most; all of them if they fit.

    Languages share the bytes evenly. Counts are taken in steps of a quarter of a
    power of two, and a step is kept whole or not at all, the highest always.
    """
    step = F.floor(F.log2("n") * 4).cast("int")
    rows = grams.groupBy("lang", step.alias("step")).agg(F.count("*").alias("rows")).collect()  # some hundred a language
    steps: dict[str, dict[int, int]] = {}
    for r in rows:
        steps.setdefault(r.lang, {})[r.step] = r.rows
    share = size // (GRAM_BYTES * max(1, len(steps)))
    least = []
    for lang, found in steps.items():
        order = sorted(found, reverse=True)
        total = np.cumsum([found[k] for k in order])
        least.append((lang, order[max(int(np.searchsorted(total, share, "right")) - 1, 0)]))
    if all(low == min(steps[lang]) for lang, low in least):
        return grams
    low = grams.sparkSession.createDataFrame(least, "lang string, least int")
    return grams.join(F.broadcast(low), "lang").filter(step >= F.col("least")).drop("least")  # a row a language


def fit(docs: DataFrame, learn: Column, per_lang: int = SAMPLE_PER_LANG, most: int = BYTES_PER_LANG, size: int = MODEL_BYTES) -> Ppm:
    """Grow the trees on at most ``per_lang`` whole documents and ``most`` bytes of each language where ``learn`` holds; beyond ``size`` bytes of trees rare grams are left out.

    Rows of null text or lang teach nothing; among others a hash of the id
    decides, in salted groups so that a frequent language is not ranked in one
    task. Of equal ids all rows count. No such row: a model of no language.
    """
    known = docs.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    group = max(1, most // SALTS)
    salted = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash"), F.octet_length("text").alias("_size")).filter(F.col("_size") <= group)
    w = Window.partitionBy("lang", "_salt").orderBy("_hash", "doc_id")
    ranked = salted.withColumn("_salt", F.pmod("_hash", F.lit(SALTS))).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max(1, per_lang // SALTS))
    ids = ranked.withColumn("_sum", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= group).select("doc_id")
    sample = known.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", "text", "lang")  # at most per_lang ids a language
    apart = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(CALIBRATE)) == 0
    with tk.Workspace(docs.sparkSession, "language") as work:
        grams = sample.filter(~apart).select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = pruned(work.save(grams, "grams"), size).toArrow()
    lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
    model = Ppm({name: (gram[lang == name], n[lang == name]) for name in dict.fromkeys(lang.tolist())})
    if model.langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        own = sample.filter(apart & (F.octet_length("text") > 0)).select("text", "lang").mapInArrow(_measure(shared), "lang string, bits array<double>").toArrow()
        model.calibrate(own.column("lang").to_pylist(), np.array(own.column("bits").to_pylist()).reshape(-1, len(model.langs)))
    return model


def identify(docs: DataFrame, model: Ppm) -> DataFrame:
    """Add lang_pred, score, bits_per_byte and known to every row of docs.

    ``und`` with score 0 for null texts and texts with no letter; score is
    the posterior of the best language under equal priors; known tells whether
    the text's bits a byte are within what that language takes. Ties go to the
    first language by name. Columns of those names in docs are replaced.
    """
    own, back = tk.aside(docs.drop("lang_pred", "score", "bits_per_byte", "known"), "text")
    return _identify(own, model).select(*back, "lang_pred", "score", "bits_per_byte", "known")


def _identify(own: DataFrame, model: Ppm) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    keep = own.columns
    marked = own.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        ppm = shared.value
        for piece in tk.slices(batches):
            buf, offsets = tk.utf8(piece.column("text"))
            size = np.maximum(np.diff(offsets), 1)
            letter = piece.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            if ppm.langs:
                bits = ppm.lengths(buf, offsets)
                best = bits.argmin(1)
                low = bits.min(1)
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                known = letter & ppm.known(best, size, low / size)
            else:
                letter[:], best, low, score, known = False, np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size)), letter & False
            lang = np.where(letter, np.array([*ppm.langs, "und"], object)[best], "und")
            cols = [piece.column(c).combine_chunks() for c in keep]
            cols += [pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(low / size), pa.array(known)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "bits_per_byte", "known"])

    schema = tk.extended(own, "lang_pred string, score double, bits_per_byte double, known boolean")
    return marked.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """``identify`` of all documents by a model that has not seen the held-out third; null texts are ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is recognised: with a posterior of ``least`` or more, and within the code lengths of that language.

    Null texts and those without a letter go; repeated rows are treated alike; all columns stay as they are.
    """
    model = fit(docs, F.lit(True))
    own, back = tk.aside(docs, "text")
    return _identify(own, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least) & F.col("known")).select(back)
