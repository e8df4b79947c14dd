"""Benchmark decontamination by latent semantic retrieval.

1. Texts become 32-bit word hashes, written once; passages of ``PASSAGE``
   words become TF-IDF vectors over ``FEATURES`` hashed features.  Document
   frequencies count the passages of the whole corpus.
2. A randomised SVD over all passages A: every task adds up its share of
   A'(A W) for a random W; the sums (features x sketch, whatever the corpus
   size) are added in a tree.  The sketch gives the leading right singular
   vectors and values (the published Nystroem form for A'A).
3. Windows of 16, 32 and 64 words of every document, moved by a block of 8,
   are compared by cosine in the whitened latent space with the benchmark
   passages of that length: the stated query set, against all rows.
4. A candidate counts when the words that it shares with the passage in
   order (longest common subsequence) make up ``LCS_ALONE`` of the passage,
   or ``LCS_ANSWER`` where the passage's answer (its last sentence, at most
   ``ANSWER`` words) is found as it stands: exact leaks and paraphrases.
   Items under ``MIN_WORDS`` words count where they are found as they stand.

The driver sees the benchmark, one vector of document frequencies and one
sketch.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, rows_to_arrow, written

FEATURES, RANK, OVERSAMPLE, SEED = 2048, 48, 16, 31
PASSAGE, BLOCK = 32, 8
SCALES = (16, 32, 64)
#: Low on purpose: exact counts of shared words sort out most candidates, and
#: a leak below this cosine is lost.
COSINE = 0.2
LCS_ALONE, LCS_ANSWER, ANSWER = 0.8, 0.6, 8
#: The words of shorter items meet by chance: they count as a whole only.
MIN_WORDS = 6
#: Words of the benchmark that travel with a task (some 200 bytes each with
#: their passages); a larger benchmark is searched for in blocks.
MAX_BENCHMARK_WORDS = 200_000
#: Documents that are looked through at once, fewer with a large benchmark:
#: their tables of passages and words have this many fields at most.
GROUP, FIELDS = 64, 1 << 19
# scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Han
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u1049\u1050-\u109d\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f"
    "\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
# words: runs of letters, digits and underscores; single characters of those scripts
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
#: The same in UTF-8 where every character beyond ASCII is a Latin letter.
_LATIN_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
_NOT_LATIN = bytes([*range(0x80, 0xC0), 0xD7, 0xF7])


def _latin(text: str) -> bool:
    """Every character is ASCII or a letter from U+00C0 to U+00FF."""
    if text.isascii():
        return True
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, _NOT_LATIN)) == len(raw)


def hashed(text: str | None) -> np.ndarray:
    """32-bit hashes of the lower-cased text's words, in order."""
    from xxhash import xxh32_intdigest

    text = (text or "").lower()
    if _latin(text):
        words = _LATIN_WORD.findall(text.encode())
    else:
        found = _WORD.findall(text)
        words = "\n".join(found).encode("utf-8", "surrogatepass").split(b"\n") if found else ()
    return np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))


WORDS_SCHEMA = "doc_id long, text_hash long, words binary"


def word_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        def each(rows):
            for r in rows:
                yield r["doc_id"], r["text_hash"], hashed(r["text"]).tobytes()

        yield from batches_of(each, arrow_schema(WORDS_SCHEMA), 256)(batches)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, WORDS_SCHEMA)


def added_up(parts: DataFrame, fan: int = 32) -> np.ndarray | None:
    """The sum of the float64 vectors in column ``v``, by a tree of tasks;
    the driver gets ``8`` of them at most."""

    def add(batches):
        total = None
        for batch in batches:
            for r in batch.column(0).to_pylist():
                v = np.frombuffer(r, np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield rows_to_arrow([(total.tobytes(),)], arrow_schema("v binary"))

    n = parts.rdd.getNumPartitions()
    while n > 8:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    rows = parts.collect()
    return sum(np.frombuffer(r["v"], np.float64) for r in rows) if rows else None


def _passages(batches, most: int = 256):
    """Feature numbers and passage numbers of up to ``most`` passages at a time."""
    features, owners, n = [], [], 0
    for batch in batches:
        for raw in batch.column(0):
            words = np.frombuffer(raw.as_buffer(), np.uint32)
            for at in range(0, len(words), PASSAGE * most):
                part = words[at : at + PASSAGE * most] % FEATURES
                features.append(part)
                owners.append(n + np.arange(len(part)) // PASSAGE)
                n += -(-len(part) // PASSAGE)
                if n >= most:
                    yield np.concatenate(features).astype(np.int64), np.concatenate(owners), n
                    features, owners, n = [], [], 0
    if n:
        yield np.concatenate(features).astype(np.int64), np.concatenate(owners), n


def frequencies(words: DataFrame) -> np.ndarray | None:
    """Passages per feature over the whole corpus; last, all passages."""

    def run(batches):
        df = np.zeros(FEATURES + 1)
        for features, owners, n in _passages(batches):
            met = np.zeros(n * FEATURES, bool)
            met[owners * FEATURES + features] = True
            df[:FEATURES] += met.reshape(n, FEATURES).sum(0)
            df[FEATURES] += n
        yield rows_to_arrow([(df.tobytes(),)], arrow_schema("v binary"))

    return added_up(words.select("words").mapInArrow(run, "v binary"))


def projection(words: DataFrame, df: np.ndarray | None = None) -> np.ndarray | None:
    """A row per feature: what one occurrence of it adds to a passage's
    whitened latent vector (IDF x right singular vectors / singular values).
    ``df`` is what :func:`frequencies` gives; None where the corpus has no
    words."""
    df = frequencies(words) if df is None else df
    if df is None or df[FEATURES] == 0:
        return None
    # a feature of every passage keeps a little weight: a corpus may be one passage
    idf = (np.log((df[FEATURES] + 1) / (df[:FEATURES] + 1)) + 0.1).astype(np.float32)
    sketch = RANK + OVERSAMPLE
    omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((FEATURES, sketch)))[0].astype(np.float32)

    def run(batches):
        total = np.zeros((FEATURES, sketch))
        room = np.zeros(0, np.float32)  # used again: only what was set is cleared
        for features, owners, n in _passages(batches):
            key = np.sort(owners * FEATURES + features)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times = np.diff(np.append(first, len(key)))
            key = key[first]
            value = times * idf[key % FEATURES]
            owner = key // FEATURES
            norm = np.sqrt(np.bincount(owner, value * value, n))
            if n * FEATURES > len(room):
                room = np.zeros(n * FEATURES, np.float32)
            room[key] = value / np.maximum(norm, 1e-6)[owner]
            a = room[: n * FEATURES].reshape(n, FEATURES)
            total += a.T @ (a @ omega)
            room[key] = 0
        yield rows_to_arrow([(total.tobytes(),)], arrow_schema("v binary"))

    z = added_up(words.select("words").mapInArrow(run, "v binary")).reshape(FEATURES, sketch)
    # Nystroem: A'A ~ Z (W'Z)^-1 Z' ; shifted for stability
    shift = 1e-6 * np.linalg.norm(z)
    z += shift * omega
    core = omega.T.astype(np.float64) @ z
    chol = np.linalg.cholesky((core + core.T) / 2 + 1e-12 * np.eye(sketch) * max(1.0, np.trace(core)))
    u, s, _ = np.linalg.svd(np.linalg.solve(chol, z.T).T, full_matrices=False)
    power = np.maximum(s * s - shift, 0)
    rank = max(1, min(RANK, int((power > 1e-6 * power[0]).sum())))
    latent = u[:, :rank] / np.sqrt(power[:rank])
    return (idf[:, None] * latent).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``lo`` to ``hi``, one range after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Benchmark:
    """Query passages: items of up to 64 words whole, longer ones in parts.

    A passage of n words can only match where ``need`` of them stand, so at
    least one of its rarest words does: the fewest, by corpus frequency, that
    leave less than ``need`` others.  ``postings`` lead from those words to
    their passages, so a text is compared with the passages that can match it
    and no table of all words and passages exists."""

    def __init__(self, items: list[tuple[int, str]], table: np.ndarray, df: np.ndarray):
        self.groups: list[dict] = []
        self.phrases: dict[int, list] = {}  # items under MIN_WORDS words, by their first
        parts = []
        for item, text in items:
            words = hashed(text)
            if len(words) < MIN_WORDS:
                if len(words):
                    self.phrases.setdefault(int(words[0]), []).append((item, words))
                continue
            sentences = [s for s in re.split(r"[.!?\n]+", text) if len(hashed(s))]
            answer = hashed(sentences[-1])[-ANSWER:]
            for at in range(0, len(words), SCALES[-1]):
                part = words[at : at + SCALES[-1]]
                if len(part) >= MIN_WORDS:
                    parts.append((item, part, answer, frozenset(part.tolist())))
        self.first = np.array(sorted(self.phrases), np.uint32)
        # by the smallest window that holds most of a passage, then by length
        edges = np.array([*(1.25 * s for s in SCALES[:-1]), np.inf])
        parts.sort(key=lambda p: (int(np.searchsorted(edges, len(p[1]))), len(p[1])))
        self.parts = parts
        known = [w for p in parts for w in p[1:3]]
        self.vocabulary = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint32)
        # stretches of 4,096 hashes that hold a word of the vocabulary
        self.near = np.zeros(1 << 20, bool)
        self.near[self.vocabulary >> 12] = True
        self.size = np.array([len(p[1]) for p in parts], np.int64)
        scale = np.searchsorted(edges, self.size)
        self.spans = [(SCALES[i], *np.searchsorted(scale, [i, i + 1]).tolist()) for i in range(len(SCALES))]
        self.q = _normal(np.array([table[p[1] % FEATURES].sum(0) for p in parts])).astype(np.float32) if parts else None
        self.alone, self.need = LCS_ALONE * self.size - 1e-6, LCS_ANSWER * self.size - 1e-6
        self.blocks = -(-np.maximum(self.size // 2, BLOCK) // BLOCK)
        self.answer = np.full((len(parts), ANSWER), len(self.vocabulary) + 1)  # none there: always met
        own_places, own_times = [], []
        heads, owners = [], []
        for k, (_, part, answer, _) in enumerate(parts):
            self.answer[k, : len(answer)] = np.searchsorted(self.vocabulary, answer)
            own, times = np.unique(part, return_counts=True)
            own_places.append(np.searchsorted(self.vocabulary, own))
            own_times.append(times)
            rarest = np.argsort(df[own % FEATURES], kind="stable")
            left = len(part) - np.cumsum(times[rarest])
            enough = int(np.argmax(left < np.ceil(self.need[k]))) + 1
            heads.append(own_places[-1][rarest[:enough]])
            owners.append(np.full(enough, k))
        # each passage's distinct words and how often it has them
        self.words = np.concatenate(own_places) if parts else np.empty(0, np.int64)
        self.times = np.concatenate(own_times) if parts else np.empty(0, np.int64)
        self.ends = np.cumsum([0, *map(len, own_places)])
        self.group = max(1, min(GROUP, FIELDS // max(1, len(self.words))))
        heads = np.concatenate(heads) if heads else np.empty(0, np.int64)
        order = np.argsort(heads, kind="stable")
        self.postings = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.bounds = np.searchsorted(heads[order], np.arange(len(self.vocabulary) + 1))

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """The passages with a rare word among the ``present`` places."""
        met = np.zeros(len(self.parts), bool)
        met[self.postings[_runs(self.bounds[present], self.bounds[present + 1])]] = True
        return np.flatnonzero(met)

    def rows(self, present: np.ndarray) -> np.ndarray:
        """Each place's number among the ``present`` ones, or how many they are."""
        rows = np.full(len(self.vocabulary) + 1, len(present))
        rows[present] = np.arange(len(present))
        return rows

    def found(self, present: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of ``some`` passages that have enough of their words among the
        ``present`` places, whose ``rows`` are given, and a table of which
        places are words of which passages, whose last row stands for any other
        word, and how many words of each passage are there."""
        lo, hi = self.ends[some], self.ends[some + 1]
        at = _runs(lo, hi)
        column = np.repeat(np.arange(len(some)), hi - lo)
        row = rows[self.words[at]]
        met = row < len(present)
        most = np.bincount(column[met], self.times[at][met], len(some))
        kept = most >= self.need[some]
        spot = np.cumsum(kept) - 1
        use = met & kept[column]
        has = np.zeros((len(present) + 1, int(kept.sum())), np.uint8)
        has[row[use], spot[column[use]]] = 1
        return some[kept], has, most[kept]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or behind its end."""
        out = np.full(len(words), len(self.vocabulary))
        at = np.flatnonzero(self.near[words >> 12])
        near = words[at]
        place = np.minimum(np.searchsorted(self.vocabulary, near), len(self.vocabulary) - 1)
        met = self.vocabulary[place] == near
        out[at[met]] = place[met]
        return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if m := places.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _holds(words: np.ndarray, part: np.ndarray) -> bool:
    """``part`` lies in ``words`` as it stands."""
    n = len(part)
    if not n or n > len(words):
        return False
    at = np.flatnonzero(words[: len(words) - n + 1] == part[0])
    return any((words[i : i + n] == part).all() for i in at.tolist())


def phrases(words: np.ndarray, bench: Benchmark) -> dict[int, tuple[float, bool, float]]:
    """The short items that lie in ``words`` as they stand, as ``matches``
    gives them."""
    found = {}
    if len(bench.first):
        for w in np.intersect1d(words, bench.first).tolist():
            for item, phrase in bench.phrases[w]:
                if _holds(words, phrase):
                    found[item] = (1.0, True, 1.0)
    return found


def _words_upto(place: np.ndarray, has: np.ndarray) -> np.ndarray:
    """For each block and passage: how many words before the block are words
    of the passage."""
    n = -(-len(place) // BLOCK)
    padded = np.full(n * BLOCK, len(has) - 1)
    padded[: len(place)] = place
    block = has[padded[::BLOCK]]
    for j in range(1, BLOCK):
        block += has[padded[j::BLOCK]]
    upto = np.zeros((n + 1, has.shape[1]), np.uint16)  # a stretch has fewer than 65,536 words
    np.cumsum(block, 0, out=upto[1:], dtype=np.uint16)
    return upto


def _enough(upto: np.ndarray, scale: int, blocks: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each window and passage: the words in and around the window suffice
    for a subsequence of ``need`` words.  ``blocks`` are the passages' margins,
    ascending."""
    n = len(upto) - 1
    at = np.arange(n)
    out = np.empty((n, upto.shape[1]), bool)
    bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for lo, hi in zip(bounds, bounds[1:]):
        margin = int(blocks[lo])
        some = upto[:, lo:hi]
        around = some[np.minimum(at + scale // BLOCK + margin, n)] - some[np.maximum(at - margin, 0)]
        np.greater_equal(around, np.ceil(need[lo:hi]).astype(np.uint16), out=out[:, lo:hi])
    return out


def _answered(stretch: np.ndarray, place: np.ndarray, bench: Benchmark, some: np.ndarray) -> np.ndarray:
    """For each of ``some`` passages: its answer lies somewhere in the stretch."""
    met = np.zeros(len(bench.vocabulary) + 2, bool)
    met[place] = True
    met[-1] = True
    out = met[bench.answer[some]].all(1)
    for j in np.flatnonzero(out).tolist():
        out[j] = _holds(stretch, bench.parts[some[j]][2])
    return out


def screened(docs: list[np.ndarray], bench: Benchmark) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of many documents: the places of its words, and the passages
    that it can hold.  Exact: no common subsequence is longer than the words of
    a passage that the document has, wherever they stand, and without all words
    of the answer it takes ``LCS_ALONE`` of them."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    cuts = np.cumsum(sizes)[:-1]
    flat = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    if not bench.parts or not len(flat):
        nothing = np.empty(0, np.int64)
        return [(nothing, nothing)] * len(docs)
    places = bench.places(flat)
    none = len(bench.vocabulary)
    here = np.zeros((len(docs), none + 2), bool)
    here[np.repeat(np.arange(len(docs)), sizes), places] = True
    here[:, none] = False
    owned = [bench.candidates(np.flatnonzero(row)) for row in here]
    doc = np.repeat(np.arange(len(docs)), np.fromiter(map(len, owned), np.int64, len(docs)))
    some = np.concatenate(owned)
    here[:, none + 1] = True  # an answer's missing words are always met
    lo, hi = bench.ends[some], bench.ends[some + 1]
    at = _runs(lo, hi)
    pair = np.repeat(np.arange(len(some)), hi - lo)
    most = np.bincount(pair, here[doc[pair], bench.words[at]] * bench.times[at], len(some))
    answered = here[doc[:, None], bench.answer[some]].all(1)
    kept = most >= np.where(answered, bench.need[some], bench.alone[some])
    doc, some = doc[kept], some[kept]
    owned = np.split(some, np.searchsorted(doc, np.arange(1, len(docs))))
    return list(zip(np.split(places, cuts), owned, strict=True))


def matches(words: np.ndarray, table: np.ndarray, bench: Benchmark, screen: tuple | None = None) -> dict[int, tuple[float, bool, float]]:
    """``item: (share of the passage found in order, answer found, cosine)``
    of one document's leaks, the largest share for each item; ``screen`` is
    what :func:`screened` gives for it."""
    found = phrases(words, bench)
    tried = set()
    places, can = screen or screened([words], bench)[0]
    if not len(can):
        return found
    for lo in range(0, len(words), 1 << 15):  # long texts in overlapping stretches
        stretch = words[max(0, lo - 2 * SCALES[-1]) : lo + (1 << 15) + 2 * SCALES[-1]]
        origin = max(0, lo - 2 * SCALES[-1])
        place = places[origin : origin + len(stretch)]
        here = np.zeros(len(bench.vocabulary) + 1, bool)
        here[place] = True
        present = np.flatnonzero(here[:-1])
        if not len(present):
            continue
        rows = bench.rows(present)
        some, has, most = bench.found(present, rows, can)
        if not len(some):
            continue
        need = np.where(_answered(stretch, place, bench, some), bench.need[some], bench.alone[some])
        if not (most >= need).any():
            continue
        # with fewer words of the passage no subsequence can do
        some, need, has = some[most >= need], need[most >= need], has[:, most >= need]
        upto = _words_upto(rows[place], has)
        tests = []
        for scale, lo_k, hi_k in bench.spans:
            part = slice(*np.searchsorted(some, [lo_k, hi_k]).tolist())
            if part.start < part.stop:
                tests.append((scale, some[part], need[part], _enough(upto[:, part], scale, bench.blocks[some[part]], need[part])))
        if not any(enough.any() for *_, enough in tests):
            continue
        plain = stretch.tolist()
        n = -(-len(stretch) // BLOCK)
        full = np.zeros((n * BLOCK, table.shape[1]), np.float32)
        full[: len(stretch)] = table[stretch % FEATURES]
        level = full.reshape(n, BLOCK, -1).sum(1)
        width = 1
        for scale, own, need, enough in tests:
            while width * BLOCK < scale:  # windows of twice the blocks
                level = level + np.concatenate((level[width:], np.zeros((min(width, n), level.shape[1]), np.float32)))[:n]
                width *= 2
            if not enough.any():
                continue
            cosine = _normal(level) @ bench.q[own].T
            near, passage = np.nonzero(enough & (cosine >= COSINE))
            for at, k in zip(near.tolist(), passage.tolist(), strict=True):
                item, part, answer, distinct = bench.parts[own[k]]
                margin = max(len(part) // 2, BLOCK)
                a = max(0, at * BLOCK - margin)
                b = at * BLOCK + scale + margin
                key = (int(own[k]), origin + a)
                if key in tried:
                    continue
                tried.add(key)
                # no subsequence is longer than the shared words and the repeated ones
                shared = len(distinct.intersection(plain[a:b])) + len(part) - len(distinct)
                if shared < need[k]:
                    continue
                region = stretch[a:b]
                share = common_subsequence(part, region) / len(part)
                if share * len(part) < need[k]:
                    continue
                has = _holds(region, answer)
                if share >= LCS_ALONE or has:
                    found[item] = max(found.get(item, (0.0, False, 0.0)), (share, has, float(cosine[at, k])))
    return found


MATCH_SCHEMA = "doc_id long, text_hash long, item_id long, share double, answer boolean, cosine double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaked benchmark items: ``doc_id, text_hash, item_id, share, answer,
    cosine``, a row per document row and item.

    ``docs`` (doc_id, text) and ``benchmark`` (item_id, text); other columns
    are not read.  Null and empty texts match nothing; items under
    ``MIN_WORDS`` words are found as whole phrases; rows without item id are not looked
    for; repeated documents are found each, repeated items once.  Empty
    tables give no rows."""
    words = written(word_table(docs), "words")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // (8 * MAX_BENCHMARK_WORDS))
    df = frequencies(words) if blocks else None
    table = projection(words, df) if blocks else None
    if table is None:
        return words.select("doc_id", "text_hash").limit(0).selectExpr(
            "doc_id", "text_hash", "0L AS item_id", "0D AS share", "false AS answer", "0D AS cosine"
        )

    def search(bench):
        def run(batches):
            def some(group):
                docs = [np.frombuffer(r["words"], np.uint32) for r in group]
                for r, words, screen in zip(group, docs, screened(docs, bench), strict=True):
                    got = matches(words, table, bench, screen)
                    for item, (share, answer, cosine) in sorted(got.items()):
                        yield r["doc_id"], r["text_hash"], item, share, answer, cosine

            def each(rows):
                group, size = [], 0
                for r in rows:
                    group.append(r)
                    size += len(r["words"])
                    if len(group) == bench.group or size >= 1 << 22:
                        yield from some(group)
                        group, size = [], 0
                if group:
                    yield from some(group)

            yield from batches_of(each, arrow_schema(MATCH_SCHEMA), 1024)(batches)

        return words.mapInArrow(run, MATCH_SCHEMA)

    found = None
    for block in range(blocks):  # each a bounded part of the benchmark
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        some = search(Benchmark(sorted({(r["item_id"], r["text"]) for r in part.collect()}), table, df))
        found = some if found is None else found.unionAll(some)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; all columns
    as they were."""
    bad = written(leaks(docs, benchmark), "leaks").select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")
    )
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash"))
    return docs.join(bad.distinct(), on, "left_anti")
