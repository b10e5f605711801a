"""N-gram Jaccard self-join: a size-aware join that treats light and heavy sets differently.

A document's set holds its distinct word shingles.  Equal sets are first folded into one class, so
exact copies cost one row each and no pairs.  Two classes link when |A & B| >= t |A | B|.

* Light sets (up to ``boundary`` shingles): two sets of sizes n <= m link exactly if they share a
  subset of the c(n, m) elements that t asks for.  Each enumerates those subsets, keyed by
  (n, m, subset); classes under one key link without further checks.
* Heavy sets post their prefix (the n - ceil(t n) + 1 first elements of a common order) to inverted
  lists; linked sets meet in a list.  Light sets that a heavy one can reach post there too.
  Elements that many documents hold come last in the order, so lists stay short; what is still
  long (groups of near copies) is tied to a known hub where it is read, with no list gathered.
* The boundary is the one with the least modelled cost over the histogram of set sizes.

Lists are scanned in rounds.  First, each class is checked against one hub, that with which it shares
most lists; this settles groups of near copies with one comparison for most copies.  Then it is checked against the
hubs of its other lists that are still in another component, and at last members of a list that still are in different
components are checked against each other.  Links that cannot change a component are the only ones left unchecked.  Pairs are compared by whole texts, in stars around the one of
the two that has more pairs: a text travels once for each pair, and a hub's once for each GROUP members.

A class is known by 64 bits of its set's hash.  Sets that share those bits, but not 64 others or their size, get names of their
own, so that classes are told apart by 128 bits and their size.

Nulls, ties and odd rows: a null or wordless text has an empty set (n_shingles 0) and links with
nothing; a null doc_id takes part (its set can carry links) but names no component, and its
component_id is null unless its component has a document with an id.  Repeated rows and repeated
ids are kept, one row out for each row in.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm import _text as T
from spreadlab.llm._session import partitions_of, shipped, spool, two_columns, unused
from spreadlab.llm.components import connected

#: Largest boundary that the cost model may choose: subsets of larger sets are too many.
MAX_LIGHT = 16
#: Documents from which an element counts as frequent, and how many frequent elements are broadcast
#: at most (16 bytes each).  Both only steer the order of elements, never the result.
FREQUENT, MAX_FREQUENT = 48, 1 << 20
#: Elements that are counted at once to find frequent ones (16 bytes each).
WINDOW = 1 << 21
#: Of so many classes one shows its elements even where they come once in a window, so that elements that are rare in all windows but
#: frequent in the whole are known; they count from SEEN such classes.
SAMPLE, SEEN = 256, 4
#: Members of a list that are compared with each other in one group, and members of a star that are compared with its hub in one.
BLOCK, GROUP = 1024, 256
#: Bytes of texts that are sent on at once, and stars (or groups of one) of a class that one row names.
SENT, TARGETS = 4 << 20, 4096
#: Bytes up to which a side of a join is broadcast; else both sides shuffle.
BROADCAST = 32 << 20
#: What a check of one candidate costs, in rows of a list.
CHECK_COST = 8


def needed(n: int, m: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes n and m that link at num/den."""
    return -(-num * (n + m) // (den + num))


def prefix_size(n, num: int, den: int):
    """Elements of which linked sets share one: n - ceil(t n) + 1."""
    return n - -(-num * n // den) + 1


def subset_rows(n: int, num: int, den: int, boundary: int) -> int:
    """Subsets that a light set of n elements enumerates."""
    return sum(comb(n, needed(n, m, num, den)) for m in range(-(-num * n // den), min(den * n // num, boundary) + 1) if needed(n, m, num, den) <= min(n, m))


def choose_boundary(histogram: dict[int, int], met: float, num: int, den: int) -> int:
    """The size up to which sets count as light, by cost; met: other members that a posting meets."""

    def cost(x: int) -> float:
        total = 0.0
        for n, k in histogram.items():
            posts = prefix_size(n, num, den) * (1 + CHECK_COST * met)
            if n <= x:
                total += k * (subset_rows(n, num, den, x) + (posts if den * n >= num * (x + 1) else 0))
            else:
                total += k * posts
        return total

    return min(range(MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _summed(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set of hashes, and of its size."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    return T.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (np.diff(bounds).astype(np.uint64) * T.M5))


def check_of(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each set that its name does not have."""
    return _summed(T.mix(g * T.M3 + T.M2), bounds)


def class_of(g: np.ndarray, bounds: np.ndarray, bits: int = 64, others: dict | None = None) -> np.ndarray:
    """A name of each row's set: equal for equal sets; 0 for the empty one.

    others: names of the sets that share theirs with another one, by (name, check, size).
    """
    n = np.diff(bounds)
    fp = _summed(T.mix(g + T.M4), bounds) & np.uint64((1 << bits) - 1)
    fp[(fp == 0) & (n > 0)] = 1
    fp[n == 0] = 0
    if others:
        for i in np.flatnonzero(np.isin(fp, np.array([k[0] for k in others], np.int64).view(np.uint64))).tolist():
            own = bounds[i : i + 2]
            key = int(fp[i : i + 1].view(np.int64)[0]), int(check_of(g[own[0] : own[1]], own - own[0]).view(np.int64)[0]), int(n[i])
            if key in others:
                fp[i] = np.array([others[key]], np.int64).view(np.uint64)[0]
    return fp


_PROFILE = "doc_id long, n long, fp long, sum long, e long, k long, share long"


def profile(batches, n_words: int, bits: int):
    """Three kinds of row: (doc_id, n, fp, sum) of each document, with the check of its set; (e, k, fp, n) of each element that
    k > 1 of the classes in a window of this partition hold, with that of those classes of whose elements most (share, in a thousand) are in others
    of the window, too: among near copies the one that is closest to all; and the same with k = -1 of each element of the classes in the sample.  A last row without fp has the postings (k) and how many of them
    repeat an element (n).

    Counts are kept for WINDOW elements at once; what they miss only moves an element in the order.
    """
    seen: set[int] = set()
    window: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = total = repeated = 0

    def elements(e, k, fp, n, share):
        return pa.record_batch({"doc_id": pa.nulls(len(e), pa.int64()), "n": pa.array(n.astype(np.int64)), "fp": pa.array(fp.view(np.int64)), "sum": pa.nulls(len(e), pa.int64()), "e": pa.array(e.view(np.int64)), "k": pa.array(k.astype(np.int64)), "share": pa.array(share.astype(np.int64))})

    def counted():
        e, fp, n = (np.concatenate(x) for x in zip(*window, strict=True))
        order = np.argsort(e)
        s = e[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        k = np.diff(np.append(first, len(s)))
        many = k > 1
        again = np.empty(len(s), bool)
        again[order] = np.repeat(many, k)
        own = np.repeat(np.arange(len(n)), n)
        share = (1000 * np.bincount(own, again, len(n)) / np.maximum(n, 1)).astype(np.int64)
        cls = np.maximum.reduceat((share[own] << 32 | own)[order], first)[many] & 0xFFFFFFFF if len(s) else first
        return elements(s[first[many]], k[many], fp[cls], n[cls], share[cls]), len(s), int((k - 1).sum())

    for batch in batches:
        for lo, hi, buf, at in T.chunks(_column(batch, "text")):
            g, bounds = T.shingle_sets(buf, at, n_words)
            fp, n = class_of(g, bounds, bits), np.diff(bounds)
            none = pa.nulls(hi - lo, pa.int64())
            yield pa.record_batch({"doc_id": _column(batch, "doc_id").slice(lo, hi - lo), "n": pa.array(n.astype(np.int64)), "fp": pa.array(fp.view(np.int64)), "sum": pa.array(check_of(g, bounds).view(np.int64)), "e": none, "k": none, "share": none})
            new = np.array([x != 0 and not (x in seen or seen.add(x)) for x in fp.tolist()], bool)
            shown = np.repeat(new & (T.mix(fp + T.M1) % np.uint64(SAMPLE) == 0), n)
            if shown.any():
                yield elements(g[shown], np.full(int(shown.sum()), -1), np.repeat(fp, n)[shown], np.repeat(n, n)[shown], np.zeros(int(shown.sum())))
            window.append((g[np.repeat(new, n)], fp[new], n[new]))
            held += len(window[-1][0])
            if held > WINDOW:
                out, x, y = counted()
                yield out
                window, held, total, repeated = [], 0, total + x, repeated + y
    if window:
        out, x, y = counted()
        yield out
        total, repeated = total + x, repeated + y
    one = pa.nulls(1, pa.int64())
    yield pa.record_batch({"doc_id": one, "n": pa.array([repeated], pa.int64()), "fp": one, "sum": one, "e": one, "k": pa.array([total], pa.int64()), "share": one})


#: kind of a posted row: a subset key of the smaller, the larger or both sizes; a list's member; a member of a frequent element's list.
#: PREFIX: not a posting, but a class's prefix on its way to the same table, as the low 32 bits of its elements.
SMALLER, LARGER, SAME, MEMBER, HOT, PREFIX = range(6)
#: salt: a frequent element's rows have their class, which deals them all over; a subset's have 64 more bits of its hash; all others 0.
#: pos: how many elements of the set come before this one in the common order.
_POST = "key long, salt long, kind int, fp long, n long, pos int, hub long, hub_n long, prefix binary"


def _post_batch(key, kind, fp, n, hub=None, hub_n=None, prefix=None, pos=None, more=None) -> pa.RecordBatch:
    zero = np.zeros(len(key), np.int64)
    return pa.record_batch({"key": pa.array(key.view(np.int64)), "salt": pa.array(fp.view(np.int64) if kind >= HOT else zero if more is None else more.view(np.int64)), "kind": pa.array(np.full(len(key), kind, np.int32)), "fp": pa.array(fp.view(np.int64)), "n": pa.array(n.astype(np.int64)), "pos": pa.array(np.zeros(len(key), np.int32) if pos is None else pos.astype(np.int32)), "hub": pa.array(zero if hub is None else hub.view(np.int64)), "hub_n": pa.array(zero if hub_n is None else hub_n.astype(np.int64)), "prefix": pa.nulls(len(key), pa.binary()) if prefix is None else pa.array(prefix, pa.binary())})


def post(batches, n_words: int, num: int, den: int, boundary: int, hot, **names):
    """Rows that bring linked classes together; each class is posted once for each partition."""
    hot_e, hot_k, hot_fp, hot_n = hot.value
    seen: set[int] = set()
    for batch in batches:
        for _, _, buf, at in T.chunks(_column(batch, "text")):
            g, bounds = T.shingle_sets(buf, at, n_words)
            fp, n = class_of(g, bounds, **names), np.diff(bounds)
            for i, x in enumerate(fp.tolist()):
                if x == 0 or x in seen:
                    n[i] = 0
                else:
                    seen.add(x)
            yield from _subsets(g, bounds, fp, n, num, den, boundary)
            pick = []
            for i in np.flatnonzero((n > 0) & (den * n >= num * (boundary + 1))).tolist():
                a, b, k = int(bounds[i]), int(bounds[i + 1]), int(prefix_size(int(n[i]), num, den))
                e = g[a:b]
                order = e >> np.uint64(1)
                if len(hot_e):
                    where = np.minimum(np.searchsorted(hot_e, e), len(hot_e) - 1)
                    is_hot = hot_e[where] == e
                    if is_hot.any():
                        order[is_hot] = np.uint64(1 << 63) | (np.minimum(hot_k[where[is_hot]], 2**31 - 1).astype(np.uint64) << np.uint64(32)) | (e[is_hot] >> np.uint64(32))
                pick.append(np.argsort(order, kind="stable")[:k] + a)
            if not pick:
                continue
            own = np.searchsorted(bounds, [x[0] for x in pick], side="right") - 1
            yield _post_batch(np.zeros(len(own), np.uint64), PREFIX, fp[own], n[own], prefix=[np.sort(g[x].astype(np.uint32)).tobytes() for x in pick])
            row = np.repeat(own, [len(x) for x in pick])
            pos = np.concatenate([np.arange(len(x)) for x in pick])
            e = g[np.concatenate(pick)]
            where = np.minimum(np.searchsorted(hot_e, e), max(len(hot_e) - 1, 0))
            is_hot = hot_e[where] == e if len(hot_e) else np.zeros(len(e), bool)
            for kind in (MEMBER, HOT):
                p = np.flatnonzero(is_hot == (kind == HOT))
                if len(p):
                    yield _post_batch(e[p], kind, fp[row[p]], n[row[p]], *((hot_fp[where[p]], hot_n[where[p]]) if kind == HOT else ()), pos=pos[p])


def _subsets(g, bounds, fp, n, num: int, den: int, boundary: int):
    """All subsets of each size that a partner of up to ``boundary`` elements asks for."""
    for size in np.unique(n[(n > 0) & (n <= boundary)]).tolist():
        rows = np.flatnonzero(n == size)
        both = [T.mix(g[bounds[rows][:, None] + np.arange(size)] + x) for x in (T.M1, T.M2)]
        for other in range(-(-num * size // den), min(den * size // num, boundary) + 1):
            c = needed(size, other, num, den)
            if c > min(size, other):
                continue
            key, more = (np.stack([T.mix(sets[:, list(pick)].sum(axis=1, dtype=np.uint64) + np.uint64(min(size, other) * 64 + max(size, other))) for pick in combinations(range(size), c)], axis=1) for sets in both)
            many = key.shape[1]
            yield _post_batch(key.ravel(), SAME if other == size else SMALLER if size < other else LARGER, np.repeat(fp[rows], many), np.full(key.size, size), more=more.ravel())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with its columns; of each component the document with the smallest id stays.

    Rows without id stay.  Rows that share id and text are one document, of which one row stays; of rows that share
    an id alone, each text stays if its component is the id's own.
    """
    (key,) = unused(docs, "key")
    found = spool(jaccard_components(docs, id_col, text_col, **options), "found")
    own = docs[id_col].cast("long")
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.expr("component_id != doc_id")).alias("gone"), F.count("*").alias("rows"))
    gone, again = gone.where("gone").select(F.col("doc_id").alias(key)), gone.where("not gone and rows > 1").select(F.col("doc_id").alias(key))
    kept = docs.join(_sized(spool(gone, "gone")), own == F.col(key), "left_anti")
    again = spool(again, "again")
    if again.isEmpty():
        return kept
    again = _sized(again)
    once = kept.join(again, own == F.col(key), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, own == F.col(key), "left_anti").unionByName(once)


def fits(n, m, num: int, den: int, boundary: int, *left):
    """Sizes that can link, at least one of them heavy, with ``left`` elements still to come on a side.

    If the first common element has p elements before it, no more than n - p can be common.
    """
    ok = (num * np.maximum(n, m) <= den * np.minimum(n, m)) & (np.maximum(n, m) > boundary)
    c = -(-num * (n + m) // (den + num))
    for x in left:
        ok &= x >= c
    return ok


def scan(batches, num: int, den: int, boundary: int):
    """One partition of posted rows, by key: hubs with members (what 0, how often in key), links of light sets (1), lists for the second round (2),
    prefixes (3), and pairs that are a whole list (4, how often in key).

    Arrays of 32 bytes a row; a key's rows are few, as frequent elements come salted and are passed on.
    """
    parts = []
    for batch in batches:
        key, salt, kind, fp, n, pos, hub, hub_n = (_column(batch, c).to_numpy() for c in ("key", "salt", "kind", "fp", "n", "pos", "hub", "hub_n"))
        hot, extra = kind == HOT, kind == PREFIX
        if extra.any():
            keep = pa.array(extra)
            yield _scan_batch(3, np.zeros(int(extra.sum()), np.int64), fp[extra], 0, n[extra], 0, _column(batch, "prefix").filter(keep))
        if hot.any():
            near = hot & fits(n, hub_n, num, den, boundary) & (fp != hub)
            yield _pairs(np.stack([hub[near], fp[near]], axis=1), 0)
            yield _scan_batch(2, key[hot], fp[hot], 0, n[hot], pos[hot])
        rest = ~(hot | extra)
        parts.append((key[rest], salt[rest], kind[rest], fp[rest], n[rest], pos[rest]))
    if not parts:
        return
    key, salt, kind, fp, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    listed = kind == MEMBER
    yield from _light(key[~listed], salt[~listed], kind[~listed], fp[~listed])
    key, fp, n, pos = key[listed], fp[listed], n[listed], pos[listed]
    order = np.argsort(key, kind="stable")
    alone = np.ones(len(key), bool)
    same = key[order[1:]] == key[order[:-1]]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    order = order[~alone]
    key, fp, n, pos = key[order], fp[order], n[order], pos[order]
    order = np.lexsort((fp, n, key))
    key, fp, n, pos = key[order], fp[order], n[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])  # a class comes once from each partition
    key, fp, n, pos = key[new], fp[new], n[new], pos[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))

    two = start[size == 2]
    two = two[fits(n[two], n[two + 1], num, den, boundary, n[two] - pos[two], n[two + 1] - pos[two + 1])]
    yield _pairs(np.sort(np.stack([fp[two], fp[two + 1]], axis=1), axis=1), 4)
    pairs, lists = [], {}
    more = size > 2
    for s, k in zip(start[more].tolist(), size[more].tolist(), strict=True):
        own, sizes, at = fp[s : s + k], n[s : s + k], pos[s : s + k]
        name = own.tobytes()
        if name in lists:  # one of equal lists is enough, with the least positions of all
            np.minimum(lists[name][3], at, out=lists[name][3])
            continue
        lists[name] = (int(key[s]), own, sizes, at.copy())
        for hub in {int(np.lexsort((own, at))[0]), int(own.argmin())}:  # the one with fewest rare elements is closest to all near copies
            near = fits(sizes, sizes[hub], num, den, boundary)
            near[hub] = False
            pairs.append(np.stack([np.full(int(near.sum()), own[hub]), own[near]], axis=1))
    if pairs:
        yield _pairs(np.concatenate(pairs), 0)
    kept = list(lists.values())
    for i in range(0, len(kept), 4096):
        some = kept[i : i + 4096]
        yield _scan_batch(2, np.repeat([x[0] for x in some], [len(x[1]) for x in some]), np.concatenate([x[1] for x in some]), 0, np.concatenate([x[2] for x in some]), np.concatenate([x[3] for x in some]))


def _pairs(p: np.ndarray, what: int) -> pa.RecordBatch:
    """Each pair once, with how often it comes."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    p = p[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])) if len(p) else np.zeros(0, np.int64)
    return _scan_batch(what, np.diff(np.append(first, len(p))), p[first, 0], p[first, 1], 0, 0)


_SCAN = "what int, key long, a long, b long, n long, pos int, prefix binary"


def _scan_batch(what, key, a, b, n, pos, prefix=None) -> pa.RecordBatch:
    def full(x, kind=np.int64):
        return pa.array(np.broadcast_to(np.asarray(x, kind), len(a)).copy())

    return pa.record_batch({"what": full(what, np.int32), "key": full(key), "a": full(a), "b": full(b), "n": full(n), "pos": full(pos, np.int32), "prefix": pa.nulls(len(a), pa.binary()) if prefix is None else prefix})


def _light(key, salt, kind, fp):
    """Classes under one subset key, of 128 bits, link: each with the least of them, where both sizes are there."""
    order = np.lexsort((fp, salt, key))
    key, salt, kind, fp = key[order], salt[order], kind[order], fp[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])) if len(key) else np.zeros(0, np.int64)
    if not len(start):
        return
    size = np.diff(np.append(start, len(key)))
    both = (np.maximum.reduceat(kind, start) == SAME) | (np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start))
    hub = np.repeat(fp[start], size)
    keep = np.repeat(both, size) & (hub != fp)
    yield _pairs(np.stack([hub[keep], fp[keep]], axis=1), 1)


def send_texts(batches, n_words: int, **names):
    """(hub, salt, fp, text) for each target (hub, salt) of a wanted class fp, where the text's set still is that class (an id may have several texts)."""
    sent: set[tuple[int, int]] = set()
    for batch in batches:
        wanted, to, part = _column(batch, "fp").to_numpy(), _column(batch, "targets"), _column(batch, "part").to_pylist()
        for lo, hi, buf, at in T.chunks(_column(batch, "text")):
            g, bounds = T.shingle_sets(buf, at, n_words)
            same = class_of(g, bounds, **names).view(np.int64) == wanted[lo:hi]
            rows = np.array([i for i in (np.flatnonzero(same) + lo).tolist() if not ((x := (int(wanted[i]), part[i])) in sent or sent.add(x))], np.int64)
            if len(rows):
                own = to.take(pa.array(rows))
                flat, row = own.flatten(), rows[pc.list_parent_indices(own).to_numpy()]
                after = np.cumsum(np.diff(at)[row - lo])  # by bytes: a long text travels in a batch of its own for each target
                k = 0
                while k < len(row):
                    n = max(1, min(1024, int(np.searchsorted(after, (after[k - 1] if k else 0) + SENT, side="right")) - k))
                    take = pa.array(row[k : k + n])
                    yield pa.record_batch({"hub": flat.field("hub").slice(k, n), "salt": flat.field("salt").slice(k, n), "fp": _column(batch, "fp").take(take), "text": _column(batch, "text").take(take)})
                    k += n


def classes_of(batches, n_words: int, **names):
    """(fp, text) of each row."""
    for batch in batches:
        for lo, hi, buf, at in T.chunks(_column(batch, "text")):
            yield pa.record_batch({"fp": pa.array(class_of(*T.shingle_sets(buf, at, n_words), **names).view(np.int64)), "text": _column(batch, "text").slice(lo, hi - lo)})


def shared_least(p, q, n, m, num: int, den: int):
    """What prefixes of p and q elements share at least, if their sets of n and m elements link.

    Of the p first elements all but n - c are common, if c are; and of two prefixes, the one that ends
    earlier in the order has its common elements in the other.
    """
    c = -(-num * (n + m) // (den + num))
    return np.maximum(1, np.minimum(p - n + c, q - m + c))


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Elements in both; only low bits are compared, which can but add to them."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _prefix_list(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint32) for x in column]


def prune(batches, num: int, den: int):
    """The pairs that can link by their prefixes."""
    for batch in batches:
        n, m = _column(batch, "n_a").to_numpy(), _column(batch, "n_b").to_numpy()
        good = np.zeros(len(n), bool)
        for i, (x, y) in enumerate(zip(_prefix_list(_column(batch, "prefix_a")), _prefix_list(_column(batch, "prefix_b")), strict=True)):
            good[i] = shared(x, y) >= shared_least(len(x), len(y), n[i], m[i], num, den)
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([_column(batch, "a").filter(keep), _column(batch, "b").filter(keep)], ["a", "b"])


def compare_lists(batches, num: int, den: int, boundary: int):
    """The pairs of a block, or of two blocks, of a list that are in different components and can link by size and position.

    Rows come sorted by (key, kind, i, j); a group has two halves of a block each at most, so what is held has a bound.
    """
    group: tuple = ()
    rows: list[tuple] = []
    done: set[tuple[int, int]] = set()

    def pairs():
        fp, n, pos, comp, half = (np.array(x) for x in zip(*rows, strict=True))
        left, right = (np.flatnonzero(half == g) for g in (0, 1))
        alone = group[1] == 1 and group[2] == group[3]  # one block with itself
        out = []
        for a in left.tolist():
            to = left[left > a] if alone else right
            to = to[fits(n[to], n[a], num, den, boundary, n[to] - pos[to], np.full(len(to), n[a] - pos[a])) & (comp[to] != comp[a])]
            for b in to.tolist():
                pair = (min(fp[a], fp[b]), max(fp[a], fp[b]))
                if pair not in done:
                    done.add(pair)
                    out.append(pair)
        if len(done) > 1 << 20:
            done.clear()
        p = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    for batch in batches:
        columns = [_column(batch, c).to_pylist() for c in ("key", "kind", "i", "j", "fp", "n", "pos", "comp", "half")]
        for x in zip(*columns, strict=True):
            if x[:4] != group:
                if rows:
                    yield pairs()
                group, rows = x[:4], []
            rows.append(x[4:])
    if rows:
        yield pairs()


def verify(batches, n_words: int, num: int, den: int):
    """The pairs (hub, member) whose texts really link; rows (hub, salt, fp, text) come by star, each star's hub first."""
    star, own = None, None
    for batch in batches:
        hub, salt, fp = (_column(batch, c).to_pylist() for c in ("hub", "salt", "fp"))
        good = np.zeros(len(hub), bool)
        for lo, hi, buf, cut in T.chunks(_column(batch, "text")):
            g, at = T.shingle_sets(buf, cut, n_words)
            for i in range(lo, hi):
                x = g[at[i - lo] : at[i - lo + 1]]
                if fp[i] == hub[i]:
                    star, own = (hub[i], salt[i]), x.copy()
                    continue
                if star != (hub[i], salt[i]):
                    raise ValueError("a star has lost its hub")
                both = np.concatenate([x, own])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                good[i] = den * inter >= num * (len(x) + len(own) - inter) and inter > 0
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([_column(batch, "hub").filter(keep), _column(batch, "fp").filter(keep)], ["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, num: int = 80, den: int = 100, name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; see the module's text."""
    spark = docs.sparkSession
    docs = two_columns(docs, id_col, text_col)
    seen = spool(docs.mapInArrow(shipped(profile, n_words=n_words, bits=name_bits), _PROFILE), "profile")
    rows, others = _told_apart(seen.where("e is null and fp is not null").select("doc_id", "n", "fp", "sum"))
    classes = rows.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"))
    names = {"bits": name_bits, "others": others}

    shown = F.sum(F.when(F.col("k") < 0, 1).otherwise(0))
    counted = seen.where("e is not null").groupBy("e").agg(F.sum(F.when(F.col("k") > 0, F.col("k")).otherwise(0)).alias("k"), (SAMPLE * F.when(shown >= SEEN, shown).otherwise(0)).alias("sampled"), F.max(F.struct("share", "fp", "n")).alias("hub"))
    counted = counted.select("e", F.greatest("k", "sampled").alias("k"), "hub.fp", "hub.n").where(f"k >= {FREQUENT}")
    top = counted.orderBy(F.desc("k"), "e").limit(MAX_FREQUENT).toArrow()
    e = top["e"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(e)
    fixed = [top[c].to_numpy().astype(np.int64)[order] for c in ("k", "fp", "n")]
    hot = spark.sparkContext.broadcast((e[order], fixed[0], fixed[1].view(np.uint64), fixed[2]))
    posted, repeated = seen.where("fp is null").agg(F.sum("k"), F.sum("n")).first()
    sizes = {r.n: r["count"] for r in rows.where(f"n > 0 and n <= {2 * MAX_LIGHT}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, (repeated or 0) / max(posted or 0, 1), num, den)

    p = docs.select("text").mapInArrow(shipped(post, n_words=n_words, num=num, den=den, boundary=boundary, hot=hot, **names), _POST)
    scanned = spool(p.repartition(partitions_of(docs), "key", "salt").mapInArrow(shipped(scan, num=num, den=den, boundary=boundary), _SCAN), "lists")
    prefixes = scanned.where("what = 3").select(F.col("a").alias("fp"), "n", "prefix")  # a class has one for each partition that holds it
    compare = {"docs": docs, "classes": classes, "names": names, "n_words": n_words, "num": num, "den": den}

    met = spool(scanned.where("what in (0, 4)").groupBy("a", "b").agg(F.sum("key").alias("votes"), F.max("what").alias("what")), "met")
    best = met.groupBy(F.col("b").alias("member")).agg(F.max(F.struct("votes", "a")).alias("x"))
    first = spool(best.select(F.least("member", "x.a").alias("a"), F.greatest("member", "x.a").alias("b")).distinct(), "first")
    links = scanned.where("what = 1").select("a", "b").unionByName(spool(_compared(pairs=spool(_pruned(first, prefixes, num, den), "near"), **compare), "links"))
    comp = spool(connected(links), "components")

    rest = spool(_apart(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), comp), "rest")
    near = spool(_pruned(rest, prefixes, num, den), "near")
    more = spool(_compared(pairs=near, **compare), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = spool(connected(links), "components")

    lists = scanned.where("what = 2").select("key", F.col("a").alias("fp"), "n", "pos")
    second = _residual(lists.distinct(), comp, partitions_of(docs), boundary, num, den).join(first, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_anti")
    near = spool(_pruned(spool(second, "second"), prefixes, num, den), "near")
    more = spool(_compared(pairs=near, **compare), "links")
    if not more.isEmpty():
        comp = spool(connected(links.unionByName(more)), "components")
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.select("fp", "comp").join(least, "comp").select("fp", "component_id")
    return rows.join(by_class, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in different components so far."""
    for side in "ab":
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
    return pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _told_apart(rows: DataFrame) -> tuple[DataFrame, dict]:
    """rows (doc_id, n, fp) with a name for each set, and the names of sets that had shared theirs: of 64-bit names a few in 10 ** 10."""
    one = F.struct("sum", "n")
    shared_names = rows.groupBy("fp").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo != hi").select("fp").limit(MAX_FREQUENT + 1).collect()
    if not shared_names:
        return rows.select("doc_id", "n", "fp"), {}
    if len(shared_names) > MAX_FREQUENT:
        raise ValueError("too many sets share a name")
    few = F.broadcast(rows.sparkSession.createDataFrame(shared_names, "fp long"))
    found = sorted(map(tuple, rows.join(few, "fp", "left_semi").select("fp", "sum", "n").distinct().collect()))
    others = {}
    for before, (fp, check, n) in zip([None, *found], found, strict=False):
        if before and before[0] == fp:  # the first one keeps the name
            three = np.array([check, fp, n], np.int64).view(np.uint64)
            others[fp, check, n] = int(T.mix(T.mix(three[:1]) + T.mix(three[1:2] + T.M1) + three[2:]).view(np.int64)[0])
    if others:
        table = rows.sparkSession.createDataFrame([(*k, v) for k, v in others.items()], "fp long, sum long, n long, own long")
        rows = rows.join(F.broadcast(table), ["fp", "sum", "n"], "left").withColumn("fp", F.coalesce("own", "fp"))
    return rows.select("doc_id", "n", "fp"), others


def _sized(table: DataFrame, size: int | None = None) -> DataFrame:
    """table, which is written, to be broadcast if its rows, of 32 bytes each or ``size`` together, are not too many."""
    size = 32 * table.count() if size is None else size
    return F.broadcast(table) if size <= BROADCAST else table


def _pruned(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b), which are written, that can link by their prefixes."""
    wanted = spool(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted")
    near = spool(prefixes.join(_sized(wanted), "fp").dropDuplicates(["fp"]), "prefixes")
    for side in "ba":
        pairs = pairs.join(near.select(*(F.col(c).alias(side if c == "fp" else f"{c}_{side}") for c in near.columns)), side)
    return pairs.mapInArrow(shipped(prune, num=num, den=den), "a long, b long")


def _compared(docs: DataFrame, classes: DataFrame, names: dict, pairs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), which are written, of classes whose whole texts link; only texts of classes in a pair are read on.

    The one of two classes that is in more pairs is the hub; its members are dealt over groups, each of which gets the hub's text.
    """
    degree = spool(pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("k")), "degree")
    both = pairs
    for side in "ab":
        both = both.join(degree.select(F.col("fp").alias(side), F.col("k").alias(f"k_{side}")), side)
    first = (F.col("k_a") > F.col("k_b")) | ((F.col("k_a") == F.col("k_b")) & (F.col("a") < F.col("b")))
    both = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.ceil(F.greatest("k_a", "k_b") / GROUP).alias("groups"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("member"), "groups"))
    sent = both.select(F.explode(F.array("hub", "member")).alias("fp"), "hub", "salt").distinct()
    sent = sent.join(degree, "fp").withColumn("part", F.pmod(F.xxhash64("hub", "salt"), F.ceil(F.col("k") / TARGETS)).cast("int"))
    targets = sent.groupBy("fp", "part").agg(F.collect_list(F.struct("hub", "salt")).alias("targets"))  # a class' stars, and groups of its own, TARGETS or so in a row
    wanted = spool(classes.join(targets, "fp").select(F.col("rep").alias("doc_id"), "fp", "part", "targets"), "wanted")
    size, unnamed = wanted.agg(F.sum(48 + 24 * F.size("targets")), F.count_if(F.col("doc_id").isNull())).first()
    texts = docs.join(_sized(wanted.where("doc_id is not null"), size or 0), "doc_id").select("fp", "part", "targets", "text")
    if unnamed:  # classes that only rows without id hold
        own = docs.where("doc_id is null").select("text").mapInArrow(shipped(classes_of, n_words=n_words, **names), "fp long, text string")
        texts = texts.unionByName(own.join(wanted.where("doc_id is null").select("fp", "part", "targets"), "fp").select("fp", "part", "targets", "text"))
    texts = texts.mapInArrow(shipped(send_texts, n_words=n_words, **names), "hub long, salt long, fp long, text string")
    stars = texts.repartition(partitions_of(docs), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("fp") != F.col("hub"))
    return stars.mapInArrow(shipped(verify, n_words=n_words, num=num, den=den), "a long, b long")


def _residual(lists: DataFrame, comp: DataFrame, parts: int, boundary: int, num: int, den: int) -> DataFrame:
    """Pairs of one list that are in different components so far and can link by size and position.

    A list's largest component is held against the other members, and those, if they are of several components, against each
    other, in blocks of about BLOCK members: two blocks meet in one group, so no group grows with its list.  A million copies and one outsider make a thousand groups, not a million blocks' pairs.
    """
    lists = spool(lists.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "pos", F.coalesce("comp", "fp").alias("comp")), "residual")
    tally = lists.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("k").alias("total"), F.max(F.struct("k", "comp")).alias("main")).where("comps > 1")
    tally = tally.select("key", "comps", F.col("main.comp").alias("main"), F.ceil(F.col("main.k") / BLOCK).alias("mains"), F.ceil((F.col("total") - F.col("main.k")) / BLOCK).alias("others"))
    rows = lists.join(tally, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))

    def group(kind: int, i, j, half):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), half.cast("int").alias("half"))

    block, none = F.col("block"), F.array().cast("array<struct<kind:int,i:bigint,j:bigint,half:int>>")
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda i: group(0, i, block, F.lit(1)))
    among = F.when(F.col("comps") > 2, F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: group(1, F.least(block, j), F.greatest(block, j), block > j))).otherwise(none)
    to = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: group(0, block, j, F.lit(0)))).otherwise(F.concat(across, among))
    rows = rows.select("key", "fp", "n", "pos", "comp", F.explode(to).alias("x")).select("key", "x.*", "fp", "n", "pos", "comp")
    rows = rows.repartition(parts, "key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")
    return rows.mapInArrow(shipped(compare_lists, num=num, den=den, boundary=boundary), "a long, b long").distinct()


#: DuckDB SQL for the rows of op6, by all pairs that share a shingle: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id
"""
