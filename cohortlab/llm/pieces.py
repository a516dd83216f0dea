"""SentencePiece encoding and decoding with distinct sampled segmentations: Gumbel top-k without replacement over the lattice.

The lattice of a text has an edge for every vocabulary piece that matches at a place. Perturbing the log-probability of each whole segmentation
by a Gumbel variable and taking the k largest draws k of them without replacement. The search is best-first with an exact bound: the largest perturbed value
below a node is itself a Gumbel variable of the node's total mass, so a node keeps its value along its best child, and its other children together get a value
truncated below it. The next sample starts at the open node with the largest value.

A text falls into units at every place that no piece of the vocabulary crosses, so its lattice is the chain of its units' lattices. Those are built once for each distinct
unit, for all new units of a batch together, and all rows of a batch are searched together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, column, gather, lists, mix, releasing, same_bytes, slices, span_hashes

MARK = "▁"
_models: dict[str, Pieces] = {}


class _Growing:
    """An array that is only appended to."""

    def __init__(self, dtype: type):
        self.held, self.n = np.empty(1 << 12, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.empty(self.n // 2 + len(x), self.held.dtype)))
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Pieces:
    """Vocabulary with log-probabilities, and the lattices of the units seen. Merge-rank scores of BPE models give a rank law: log p falls with log(rank + 10).

    A lattice has a node before each byte of its unit and one at its end; edges leave the nodes before characters, the longest first. A character without a piece of its own
    has an edge that stands for its bytes (number `size` + bytes).
    """

    def __init__(self, path: str, most_units: int = 400_000, most_edges: int = 8_000_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        ordinary = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(ordinary, key=lambda i: (-sp.get_score(i), i))
        weight = 1.0 / (np.arange(len(order)) + 10.0)
        log_p = np.log(weight / weight.sum() * 0.999)
        self.vocabulary = {sp.id_to_piece(i): (i, float(p)) for i, p in zip(order, log_p)}
        self.byte_log = float(np.log(0.001 / 256))
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        said = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode("utf-8", "surrogatepass") for i in range(self.size)]
        self.piece_n = np.array([len(x) for x in said], np.int64)
        self.piece_at, self.piece_flat = np.cumsum(self.piece_n) - self.piece_n, np.frombuffer(b"".join(said), np.uint8)
        self.log_p = np.full(self.size, -np.inf)
        self.log_p[order] = log_p
        self._index(order, said)
        self.most_units, self.most_edges = most_units, most_edges
        self.clear()

    def _index(self, order: list[int], said: list[bytes]) -> None:
        """A trie over the bytes of the pieces, and the pairs of bytes around the places between characters that pieces cross."""
        children: list[dict[int, int]] = [{}]
        end: list[int] = [-1]
        self.crossed = np.zeros((256, 256), bool)
        for i in order:
            node, last = 0, -1
            for b in said[i]:
                if last >= 0 and b & 0xC0 != 0x80:
                    self.crossed[last, b] = True
                last = b
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    end.append(-1)
                node = children[node][b]
            end[node] = i
        self.trie = np.zeros((len(children), 256), np.uint16 if len(children) < 1 << 16 else np.int32)
        for node, own in enumerate(children):
            for b, child in own.items():
                self.trie[node, b] = child
        self.ends = np.array(end, np.int32)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def clear(self) -> None:
        self.keys, self.base, self.text_at, self.text_n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.text = _Growing(np.uint8)
        self.mask = np.uint64((1 << int(np.ceil(np.log2(4 * self.most_units)))) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.first, self.degree = _Growing(np.int32), _Growing(np.uint8)  # by node: its first edge and how many there are
        self.to, self.piece = _Growing(np.int32), _Growing(np.int32)  # by edge: the byte of the unit it leads to, its piece
        self.share, self.upto, self.rest = _Growing(np.float64), _Growing(np.float32), _Growing(np.float32)  # logarithm of its share, sum of the shares up to it, logarithm of the others' sum

    def normalize(self, texts: list[str]) -> pa.Array:
        return pa.array([self.sp.normalize(x) if x else "" for x in texts], pa.large_string())

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units of all rows, and the first unit of each row (n + 1)."""
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.crossed[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def _edges(self, u: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, piece, log-probability) of the edges of the units u[off[i] : off[i + 1]], by walking the trie from all characters at once: longest first, each part in order of `from`."""
        stop = np.repeat(off[1:], np.diff(off))
        begin = np.flatnonzero(u & 0xC0 != 0x80)
        wide = np.minimum(np.append(begin[1:], len(u)), stop[begin]) - begin
        at, limit, node, depth, found = begin, stop[begin], np.zeros(len(begin), self.trie.dtype), 0, []
        own, trie = np.zeros(len(u), bool), self.trie.ravel()
        wide_at = np.zeros(len(u), np.int64)
        wide_at[begin] = wide
        while len(at):
            node = trie.take((node.astype(np.int64) << 8) + u.take(at + depth))
            depth += 1
            piece = self.ends.take(node)  # -1 for the root, too
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                start, ids = at[hit], piece[hit]
                found.append((start, start + depth, ids, self.log_p[ids]))
                own[start[wide_at[start] == depth]] = True
            on = np.flatnonzero((node > 0) & (at + depth < limit))
            at, limit, node = at.take(on), limit.take(on), node.take(on)
        bare = begin[~own[begin]]  # no piece for the character: its bytes
        return [*reversed(found), (bare, bare + wide_at[bare], (self.size + wide_at[bare]).astype(np.int32), self.byte_log * wide_at[bare])]

    def _add(self, u: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Build the lattices of units; the first node of each. All sums run within a node, in one order, so a unit's lattice doesn't depend on the others."""
        m, nodes = len(off) - 1, len(u) + len(off) - 1
        unit = np.repeat(np.arange(m), np.diff(off))
        parts = self._edges(u, off)
        degree = np.zeros(nodes, np.int64)
        for start, *_ in parts:
            degree[start + unit[start]] += 1
        first = np.cumsum(degree) - degree
        total, fill = int(degree.sum()), first.copy()
        to, piece, lp, end = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
        for start, stop, ids, log_p in parts:
            own = unit[start]
            node = start + own
            e = fill[node]
            fill[node] += 1
            to[e], piece[e], lp[e], end[e] = stop - off[own], ids, log_p, stop + own
        # log-mass of all ways from a node to the end, the nodes nearest to it first
        held = np.flatnonzero(degree)
        last = off[1:] + np.arange(m)  # the node at the end of each unit
        far = np.repeat(last, np.diff(off) + 1).take(held) - held
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        near = held[order]
        bounds = np.append(np.flatnonzero(np.diff(far[order], prepend=-1)), len(near))
        back = np.zeros(nodes)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            node = near[i:j]
            n = degree.take(node)
            if n.max() == 1:
                e = first.take(node)
                back[node] = lp.take(e) + back.take(end.take(e))
                continue
            e = _ranges(first.take(node), n)
            value, head = lp.take(e) + back.take(end.take(e)), np.cumsum(n) - n
            top = np.maximum.reduceat(value, head)
            back[node] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), head))
        share = lp + back.take(end) - np.repeat(back, degree)
        p = np.exp(share)
        upto, at, d = np.ones(total), held[degree.take(held) > 1], 0  # 1 at the last edge of a node
        sums = np.zeros(len(at))
        while len(at):
            e = first.take(at) + d
            sums += p.take(e)
            upto[e] = sums
            d += 1
            on = np.flatnonzero(degree.take(at) > d + 1)
            at, sums = at.take(on), sums.take(on)
        # what the other edges of a node have: exactly where one edge has nearly all
        rest, large = 1.0 - p, p > 0.5
        others = np.add.reduceat(np.where(large, 0.0, p), first[held]) if total else np.empty(0)
        rest = np.where(large, np.repeat(others, degree[held]), rest)
        node, edge = self.first.n, self.to.n
        self.first.add(first + edge), self.degree.add(degree)
        self.to.add(to), self.piece.add(piece), self.share.add(share), self.upto.add(upto)
        with np.errstate(divide="ignore"):
            self.rest.add(np.log(rest))
        return node + off[:-1] + np.arange(m)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        """Number of the unit with each hash, or -1: the slots from that of its low bits on are looked at, up to a free one."""
        out, todo, step = np.full(len(h), -1), np.arange(len(h)), 0
        while len(todo):
            unit = self.slots[(h[todo] + np.uint64(step)) & self.mask]
            hit = unit >= 0
            todo, unit = todo[hit], unit[hit]
            right = self.keys[unit] == h[todo]
            out[todo[right]] = unit[right]
            todo, step = todo[~right], step + 1
        return out

    def _enter(self, h: np.ndarray, unit: np.ndarray) -> None:
        """Give new units the first free slot from that of their hash on."""
        step = 0
        while len(h):
            at = (h + np.uint64(step)) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = unit[free]  # of several units for one slot the last one gets it
            left = self.slots[at] != unit
            h, unit, step = h[left], unit[left], step + 1

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First node of the lattice of each unit. Bytes are compared at every hit; units whose hash another one holds get lattices of their own."""
        if len(self.keys) > self.most_units or self.to.n > self.most_edges:
            self.clear()
        size, h = ends - starts, span_hashes(data, starts, ends)
        which = self._slot(h)
        if (missing := np.flatnonzero(which < 0)).size:
            keys, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            one = missing[one]
            begin, n = starts[one], size[one]
            u = gather(data, begin, n)
            text_at = self.text.n + np.cumsum(n) - n
            self.text.add(u)
            unit = len(self.keys) + np.arange(len(keys))
            base = self._add(u, np.concatenate(([0], np.cumsum(n))))
            for name, x in (("keys", keys), ("base", base), ("text_at", text_at), ("text_n", n)):
                setattr(self, name, np.concatenate((getattr(self, name), x)))
            self._enter(keys, unit)
            which[missing] = unit[back]
        out, same = self.base[which], size == self.text_n[which]
        same[same] = same_bytes(data, starts[same], self.text.all, self.text_at[which[same]], size[same])
        if not same.all():
            other = np.flatnonzero(~same)
            out[other] = self._add(gather(data, starts[other], size[other]), np.concatenate(([0], np.cumsum(size[other]))))
        return out

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after the other, with the mark for spaces, and how many each has."""
        n = self.piece_n.take(ids)
        return gather(self.piece_flat, self.piece_at.take(ids), n), n

    def decode(self, ids: list[int]) -> str:
        """The normalised text, with spaces, less the one put before it."""
        text = self.bytes_of(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _below(mass: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel variables of log-mass `mass`, below `bound`."""
    return mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(u))


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. (n[i] numbers) of all i, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


#: No Gumbel variable of a 53-bit uniform number is above its location by more than this.
MOST_ABOVE = 38.0


class _Path:
    """One sample of some rows: the steps (unit, place in it, edge) of all of them, row after row, and the values of the nodes left open beside them.

    The mass beside a step falls along the path, so only values of the steps within `WINDOW` of the first are computed; `floor` is what the others can't exceed.
    """

    WINDOW = 60.0

    def __init__(self, rows: np.ndarray, n: np.ndarray, unit: np.ndarray, place: np.ndarray, edge: np.ndarray, lp: np.ndarray):
        self.rows, self.start = rows, np.concatenate(([0], np.cumsum(n)))
        self.unit, self.place, self.edge = unit, place, edge
        self.run = np.concatenate(([0.0], np.cumsum(lp)))  # never rises
        self.total = np.add.reduceat(lp, self.start[:-1]) if len(n) else np.empty(0)
        self.split, self.mask, self.split_value = np.full(len(rows), -1), np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)  # the step that left another path, the edges taken there, the others' value
        self.fresh, self.window = self.start[:-1], np.full(len(rows), self.WINDOW)
        self.taken: list[np.ndarray] = []  # steps whose open nodes were taken

    def mass(self, at: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Log-probability of the steps before `at`, in the row at place `where`."""
        return self.run[at] - self.run[self.start[where]]

    def open(self, value: Callable[[_Path, np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Compute the open values within each row's window."""
        end = self.start[1:]
        stop = np.minimum(end, np.maximum(self.fresh, np.searchsorted(-self.run, self.window - self.run[self.fresh], "right")))
        self.floor = np.where(stop < end, self.run[stop] - self.run[self.start[:-1]] + MOST_ABOVE, -np.inf)
        n = stop - self.fresh
        at, where = _ranges(self.fresh, n), np.repeat(np.arange(len(n)), n)
        worth = value(self, at, where)
        first = np.flatnonzero(self.split >= 0)
        at, where, worth = np.concatenate((self.split[first], at)), np.concatenate((first, where)), np.concatenate((self.split_value[first], worth))
        some = np.flatnonzero(worth > -np.inf)
        some = some[np.argsort(at[some], kind="stable")]
        self.at, self.where, self.worth = at[some], where[some], worth[some]
        for x in self.taken:
            self.worth[np.searchsorted(self.at, x[np.isin(x, self.at)])] = -np.inf

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows (places) with open nodes, the largest value of each, and the step it stands at."""
        heads = np.flatnonzero(np.diff(self.where, prepend=-1))
        if not len(heads):
            return heads, np.empty(0), heads
        top = np.maximum.reduceat(self.worth, heads)
        equal = np.flatnonzero(self.worth == np.repeat(top, np.diff(np.append(heads, len(self.where)))))
        return self.where[heads], top, self.at[equal[np.searchsorted(equal, heads)]]

    def take(self, at: np.ndarray) -> None:
        self.taken.append(at)
        self.worth[np.searchsorted(self.at, at)] = -np.inf


def sample_segmentations(model: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """k rounds of (rows, ids, offsets of the ids, log-probabilities, perturbed values), and last (all rows, -, -, -, their next values).

    data, offsets: the bytes of normalised texts; keys: a 64-bit seed for each row. Rows with fewer than k segmentations drop out of later rounds; a row without bytes has one.
    """
    n_rows = len(offsets) - 1
    starts, ends, first_unit = model.units(data, offsets)
    base, size = model.find(data, starts, ends), ends - starts
    row_of = np.repeat(np.arange(n_rows), np.diff(first_unit))
    in_row = starts - offsets[row_of]
    first, degree, to, piece, share, upto, rest = (x.all for x in (model.first, model.degree, model.to, model.piece, model.share, model.upto, model.rest))

    def seeds(turn: int) -> np.ndarray:
        return mix(keys ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))

    PLACE, SALT = np.uint64(4 * 0xC2B2AE3D27D4EB4F % (1 << 64)), 0xC2B2AE3D27D4EB4F
    row_place = in_row.astype(np.uint64) * PLACE

    def salted(seed: np.ndarray, salt: int) -> np.ndarray:
        """The start of the hashes of each unit's places, by the seeds of the rows."""
        out = seed.take(row_of)
        out += row_place
        out += np.uint64(salt * SALT % (1 << 64))
        return out

    def salted_at(seed: np.ndarray, salt: int, unit: np.ndarray) -> np.ndarray:
        """The same for some of the units."""
        out = seed.take(row_of.take(unit))
        out += row_place.take(unit)
        out += np.uint64(salt * SALT % (1 << 64))
        return out

    def uniform(start: np.ndarray, place: np.ndarray) -> np.ndarray:
        h = place.astype(np.uint64)
        h *= PLACE
        h += start
        t = np.empty_like(h)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            np.right_shift(h, np.uint64(33), out=t)
            h ^= t
            h *= np.uint64(factor)
        np.right_shift(h, np.uint64(33), out=t)
        h ^= t
        h >>= np.uint64(11)
        out = h.astype(np.float64)
        out += 0.5
        out *= 2.0**-53
        return out

    def walk(unit: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draw edges from each place to the end of its unit: (steps of each, unit, place, edge), in order."""
        count, drawn, start = np.zeros(len(unit), np.int64), [], salted(seed, 1)
        which = np.flatnonzero(place < size.take(unit))
        w, p = unit[which], place[which]
        while len(w):
            edge = first.take(base.take(w) + p).astype(np.int64)
            u = uniform(start.take(w), p)
            later = np.flatnonzero(upto.take(edge) < u)
            while len(later):
                edge[later] += 1
                later = later[upto.take(edge[later]) < u[later]]
            drawn.append((which, edge))
            count[which] = len(drawn)
            p = to.take(edge).astype(np.int64)
            on = np.flatnonzero(p < size.take(w))
            which, w, p = which.take(on), w.take(on), p.take(on)
        off = np.cumsum(count) - count
        out_e = np.empty(int(count.sum()), np.int64)
        for j, (which, edge) in enumerate(drawn):
            out_e[off.take(which) + j] = edge
        out_p = np.empty(len(out_e), np.int64)
        out_p[1:] = to.take(out_e[:-1])
        some = np.flatnonzero(count)
        out_p[off[some]] = place[some]
        return count, np.repeat(unit, count), out_p, out_e

    def values(seed: np.ndarray, value: np.ndarray) -> Callable[[_Path, np.ndarray, np.ndarray], np.ndarray]:
        """Of the nodes beside steps, below the values of the path's rows."""

        def of(path: _Path, at: np.ndarray, where: np.ndarray) -> np.ndarray:
            other = rest.take(path.edge.take(at)).astype(np.float64)
            out, some = np.full(len(at), -np.inf), np.flatnonzero(other > -np.inf)  # nodes with more than one edge
            at, where = at[some], where[some]
            row = path.rows[where]
            out[some] = _below(path.mass(at, where) + other[some], uniform(salted_at(seed, 2, path.unit.take(at)), path.place.take(at)), value[row])
            return out

        return of

    def result(path: _Path, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = piece.take(path.edge)
        off = path.start
        if (many := ids >= model.size).any():  # bytes in place of a piece
            each = np.where(many, ids - model.size, 1)
            raw = gather(data, (starts[path.unit] + path.place)[many], each[many])
            wide, off = np.repeat(many, each), np.concatenate(([0], np.cumsum(each)))[path.start]
            ids = np.repeat(ids, each)
            ids[wide] = model.byte_ids[raw]
        total, rows, out_off, out_p = path.total, path.rows, off, path.total
        if len(paths) == 1 and (bare := np.flatnonzero(np.diff(first_unit) == 0)).size:  # texts without bytes
            rows = np.arange(n_rows)
            length, lp = np.zeros(n_rows, np.int64), np.zeros(n_rows)
            length[path.rows], lp[path.rows] = np.diff(off), total
            out_off, out_p = np.concatenate(([0], np.cumsum(length))), lp
        return rows, ids.astype(np.int32, copy=False), out_off, out_p, value[rows]

    own = mix(seeds(0) + np.uint64(3))
    value = -np.log(-np.log(((own >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53))  # of the whole lattice, whose log-mass is 0
    paths: list[_Path] = []
    count, w, p, e = walk(np.arange(len(base)), np.zeros(len(base), np.int64), seeds(0))
    steps = np.bincount(row_of, count, n_rows).astype(np.int64)
    full = np.flatnonzero(steps)
    path = _Path(full, steps[full], w, p, e, share.take(e))
    path.values = values(seeds(0), value)
    path.open(path.values)
    out = []
    for turn in range(k):
        paths.append(path)
        out.append(result(path, value))
        # the open node of the largest value, over all paths of a row
        while True:
            best, best_path, best_at, floor = np.full(n_rows, -np.inf), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.full(n_rows, -np.inf)
            for s, own in enumerate(paths):
                where, top, at = own.best()
                r = own.rows[where]
                better = top > best[r]
                best[r[better]], best_path[r[better]], best_at[r[better]] = top[better], s, at[better]
                floor[own.rows] = np.maximum(floor[own.rows], own.floor)
            if not (short := floor >= best)[floor > -np.inf].any():
                break
            for own in paths:  # a value that was not computed could be larger
                if (more := short[own.rows] & (own.floor > -np.inf)).any():
                    own.window[more] = np.inf
                    own.open(own.values)
        value, go = best, np.flatnonzero(np.isfinite(best))
        if turn == k - 1 or not len(go):
            break
        # the step each row leaves its path at, what was taken there, and how far the path is kept
        at_w, at_p, taken, mass, kept = (np.zeros(len(go), t) for t in (np.int64, np.int64, np.int64, float, np.int64))
        for s, own in enumerate(paths):
            mine = best_path[go] == s
            if not mine.any():
                continue
            at, where = best_at[go[mine]], np.searchsorted(own.rows, go[mine])
            own.take(np.sort(at))
            at_w[mine], at_p[mine], mass[mine], kept[mine] = own.unit[at], own.place[at], own.mass(at, where), at - own.start[where]
            taken[mine] = np.where(own.split[where] == at, own.mask[where], np.left_shift(np.int64(1), own.edge[at] - first[base[own.unit[at]] + own.place[at]]))
        node, seed = base[at_w] + at_p, seeds(turn + 1)
        deg, begin = degree[node].astype(np.int64), first[node].astype(np.int64)
        free, edge = np.zeros(len(go)), np.full(len(go), -1)
        for d in range(int(deg.max())):
            ok = (d < deg) & (taken >> d & 1 == 0)
            free[ok] += np.exp(share[begin[ok] + d])
        u, done = uniform(salted_at(seed, 0, at_w), at_p) * free, np.zeros(len(go))
        for d in range(int(deg.max())):  # an edge other than those taken, by its share
            ok = (d < deg) & (taken >> d & 1 == 0)
            take = ok & ((edge < 0) | (done < u))
            edge[take] = begin[take] + d
            done[ok] += np.exp(share[begin[ok] + d])
        taken = taken | np.left_shift(np.int64(1), edge - begin)
        left = np.zeros(len(go))
        for d in range(int(deg.max())):
            ok = (d < deg) & (taken >> d & 1 == 0)
            left[ok] += np.exp(share[begin[ok] + d])
        # from there: the rest of the unit, and the units after it
        after = first_unit[go + 1] - at_w  # the unit itself and the later ones
        entry = np.cumsum(after) - after
        units = _ranges(at_w, after)
        places = np.zeros(len(units), np.int64)
        places[entry] = to[edge]
        count, w, p, e = walk(units, places, seed)
        fresh_n = np.add.reduceat(count, entry)
        n = kept + 1 + fresh_n
        begin_at = np.cumsum(n) - n
        all_w, all_p, all_e = (np.empty(int(n.sum()), np.int64) for _ in range(3))
        for s, own in enumerate(paths):
            mine = best_path[go] == s
            if mine.any():
                source = _ranges(own.start[np.searchsorted(own.rows, go[mine])], kept[mine])
                dest = _ranges(begin_at[mine], kept[mine])
                all_w[dest], all_p[dest], all_e[dest] = own.unit.take(source), own.place.take(source), own.edge.take(source)
        here = begin_at + kept
        all_w[here], all_p[here], all_e[here] = at_w, at_p, edge
        dest = _ranges(here + 1, fresh_n)
        all_w[dest], all_p[dest], all_e[dest] = w, p, e
        path = _Path(go, n, all_w, all_p, all_e, share.take(all_e))
        path.split, path.mask, path.fresh = here, taken, here + 1
        more = left > 0
        path.split_value[more] = _below(mass[more] + np.log(left[more]), uniform(salted_at(seed, 2, at_w[more]), at_p[more]), value[go[more]])
        path.values = values(seed, value)
        path.open(path.values)
    none = np.empty(0, np.int64)
    out.append((np.arange(n_rows), none, none, none, value))
    return out


def sample_pieces(df: DataFrame, model_path: str, key_cols: list[str], text_col: str = "text", k: int = 4, seed: int = 0, with_ids: bool = True, rows_a_batch: int = 4096, bytes_a_batch: int = 1 << 20) -> DataFrame:
    """(key_cols, sample, n_pieces, ids, ids_crc32, log_prob, inclusion, log_inclusion, decoded): up to k distinct segmentations of each text, in the order they are drawn.

    inclusion is the chance that a draw above the (k+1)-th perturbed value takes in this segmentation (1 if there are no more than k);
    that of one segmentation of a long text can be below the least double, its logarithm is not. The seed is a hash of the row's key columns; equal keys draw alike. Null and empty texts have one segmentation without pieces; an empty df has none. decoded: do the ids decode to the normalised
    text? Without with_ids the column of ids stays in the workers; its CRC-32 (of little-endian unsigned 32-bit integers) is given in either case. Key columns must not bear the names of outputs;
    no other column is read.
    """
    if clash := {"sample", "n_pieces", "ids", "ids_crc32", "log_prob", "inclusion", "log_inclusion", "decoded"} & set(key_cols):
        raise ValueError(f"key columns with the names of outputs: {sorted(clash)}")
    kept = df.select(*key_cols, F.xxhash64(*key_cols, F.lit(seed)).alias("__key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    names = [*key_cols, "sample", "n_pieces", *(["ids"] if with_ids else []), "ids_crc32", "log_prob", "inclusion", "log_inclusion", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(model_path)
        sized = ((whole, r) for whole in batches for r in slices(buffers(column(whole, "__text"))[1], bytes_a_batch))
        for batch in releasing(whole.slice(i, min(i + rows_a_batch, end) - i) for whole, (start, end) in sized for i in range(start, end, rows_a_batch)):
            data, offsets = buffers(model.normalize(column(batch, "__text").to_pylist()))
            keys = column(batch, "__key").to_numpy().view(np.uint64)
            *rounds, (_, _, _, _, bound) = sample_segmentations(model, data, offsets, keys, k)
            for s, (rows, ids, off, log_p, _) in enumerate(rounds):
                said, n = model.bytes_of(ids)
                length = np.concatenate(([0], np.cumsum(n)))[off]
                fine = np.diff(length) == np.diff(offsets)[rows]
                for r in np.flatnonzero(fine).tolist():
                    fine[r] = np.array_equal(said[length[r] : length[r + 1]], data[offsets[rows[r]] : offsets[rows[r] + 1]])
                ahead = np.minimum(log_p - bound[rows], 50.0)
                inclusion = -np.expm1(-np.exp(ahead))
                log_inclusion = np.where(ahead < -30, ahead, np.log(np.maximum(inclusion, 1e-300)))
                raw = ids.astype("<u4")
                crc = pa.array([zlib.crc32(raw[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*(column(batch, c).take(pa.array(rows)) for c in key_cols), pa.array(np.full(len(rows), s, np.int32)), pa.array(np.diff(off)), *([lists(ids, off)] if with_ids else []), crc, pa.array(log_p), pa.array(inclusion), pa.array(log_inclusion), pa.array(fine, pa.bool_())], names)

    kinds = dict(df.select(*key_cols).dtypes) | {"sample": "int", "n_pieces": "long", "ids": "array<int>", "ids_crc32": "long", "log_prob": "double", "inclusion": "double", "log_inclusion": "double", "decoded": "boolean"}
    return kept.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
