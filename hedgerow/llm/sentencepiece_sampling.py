"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node before each character and an edge for each vocabulary piece that matches there; a character that
no piece covers is spelled in byte pieces. A path through it is a segmentation, with a probability in proportion to the
product of its pieces' weights. The k paths with the largest Gumbel-perturbed log-probabilities are k distinct samples without
replacement. Perturbed A-star search finds them: the search space is a queue of disjoint sets of paths, each with the exact
maximum of its perturbed values (a Gumbel truncated at its parent's); the best set is split at the path that attains it into
"the same up to step t, another edge at t" for each step t. That bound is exact, so the search never expands a path in vain.

Where no piece crosses from a character other than the space mark to the space mark, or a line feed, a lattice is a chain of
small ones that texts share: these are built once for each distinct unit of a worker, and paths of all texts of a chunk are
drawn together in numpy. With a vocabulary that has such pieces a unit is a whole text. The random numbers are hashes of the row key and of the step, and a
unit's numbers depend on the unit alone, so that a row's samples and scores depend on its key and text only, to the last bit. Steps from GROUP on share one entry of the queue, which is split when it is reached.

The inclusion score of a sample is the probability that its perturbed value exceeds the (k+1)-th one, 1 if there is none.

Weights: the model at hand is a BPE model, which has ranks and no probabilities: piece weights follow Zipf's law in the rank
(``1 / (rank + 2)``, to the power ``alpha``); a unigram model's log-probabilities can be given instead.

Nulls: a null text is an empty one, whose only segmentation is the empty one; a text with fewer than k segmentations gives all
it has. A null key counts as the empty text; rows with the same key and text get the same samples. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import text_or_empty
from hedgerow.llm.rolling import HashTable, RangeHash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a space mark that the text itself has; no valid UTF-8 text has a lone surrogate.
LITERAL = "\ud800"
K = 2
ALPHA = 1.0
GROUP = 48
#: Units whose lattices a worker keeps. Samples depend neither on this nor on CHUNK_CHARS, the characters sampled at a time; the worker's memory does.
CACHE_UNITS = 40_000
#: Characters of a unit that is told by another hash.
LONG_UNIT = 64
CHUNK_CHARS = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the parts alone."""
    h = np.zeros(1, np.uint64)
    scalar = all(np.ndim(p) == 0 for p in parts)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h ^= h >> np.uint64(31)
    out = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return out[0] if scalar else out


class Growing:
    """An array that grows at its end, in doubling."""

    def __init__(self, first: np.ndarray):
        self._room, self.all = first, first

    def extend(self, more: np.ndarray) -> None:
        n = len(self.all) + len(more)
        if n > len(self._room):
            room = np.empty(max(n, 2 * len(self._room)), self._room.dtype)
            room[: len(self.all)] = self.all
            self._room = room
        self._room[n - len(more) : n] = more
        self.all = self._room[:n]


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Vocabulary:
    """Pieces with their log weights; byte_ids has the id of each byte's piece."""

    pieces: list[str]
    log_weights: np.ndarray
    byte_ids: list[int]

    def __post_init__(self) -> None:
        """All beginnings of pieces by hash, with the piece's id where it ends there, else -1."""
        prefixes: dict[str, int] = {}
        bytes_ = {i: b for b, i in enumerate(self.byte_ids)}
        for i in range(len(self.pieces)):
            if i in bytes_ or not np.isfinite(self.log_weights[i]):
                continue
            p = self.pieces[i]
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        # units end before a space mark and around a line feed, unless a piece goes on there
        self.crosses = any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p, i in prefixes.items() if i >= 0)
        raw = [bytes([bytes_[i]]) if i in bytes_ else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        ends = np.cumsum(sizes)
        hashes = RangeHash(code_points("".join(prefixes))).of(ends - sizes, ends)
        order = np.argsort(hashes)
        self.table, self.piece_at = HashTable(hashes[order]), np.fromiter(prefixes.values(), np.int64, len(prefixes))[order]

    def data_of(self, pieces: np.ndarray) -> bytes:
        """The bytes of all pieces, one after the other."""
        sizes = self.sizes[pieces]
        shift = np.repeat(self.places[pieces] - (np.cumsum(sizes) - sizes), sizes)
        return self.data[shift + np.arange(len(shift))].tobytes()

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rank = np.arange(n, dtype=float)
        weights = -alpha * np.log(rank + 2)
        weights[[i for i in range(n) if model.is_control(i) or model.is_unknown(i)]] = -np.inf
        return Vocabulary([model.id_to_piece(i) for i in range(n)], weights, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Lattices:
    """The lattices of the units seen so far. Node numbers are global; a node's edges lie together, a unit's last node has none.

    An edge has the node it leads to, its pieces (edge_atoms and edge_size: where they begin in ``atoms`` and how many they
    are, several only for a character spelled in bytes), its probability in its node, and the sum of those up to it in the node. A unit's
    numbers depend on the unit alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.atoms = list(range(len(vocabulary.pieces)))
        self.atom_array = np.array(self.atoms, np.int32)
        self.spelled: dict[int, tuple[int, int]] = {}
        self.ids: dict[int, int] = {}
        kinds = {"root": np.int64, "edge_from": np.int64, "edge_to": np.int64, "edge_atoms": np.int32, "edge_size": np.int16, "edge_p": np.float64, "edge_cum": np.float64}
        self._grown = {c: Growing(np.zeros(0, kind)) for c, kind in kinds.items()} | {"first_edge": Growing(np.zeros(1, np.int64))}
        self._show()

    def _show(self) -> None:
        g = self._grown
        self.root, self.first_edge, self.edge_from, self.edge_to = g["root"].all, g["first_edge"].all, g["edge_from"].all, g["edge_to"].all
        self.edge_atoms, self.edge_size, self.edge_p, self.edge_cum = g["edge_atoms"].all, g["edge_size"].all, g["edge_p"].all, g["edge_cum"].all

    def _spell(self, point: int) -> tuple[int, int]:
        if point not in self.spelled:
            raw = SPACE.encode() if chr(point) == LITERAL else chr(point).encode()
            self.spelled[point] = len(self.atoms), len(raw)
            self.atoms += [self.v.byte_ids[b] for b in raw]
        return self.spelled[point]

    def _edges(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Source character, length, atoms, their number and log weight of all edges, by source and then by length."""
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        hashed = RangeHash(text)
        live, found, one = np.arange(len(text)), [], np.zeros(len(text), bool)
        length = 1
        while len(live):
            at, there = self.v.table.look_up(hashed.of(live, live + length))
            live, at = live[there], at[there]
            piece = self.v.piece_at[at]
            whole = piece >= 0
            found.append((live[whole], np.full(whole.sum(), length), piece[whole]))
            if length == 1:
                one[live[whole]] = True
            length += 1
            live = live[room[live] >= length]
        source, lengths, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        bare = np.flatnonzero(~one)
        points, which = np.unique(text[bare], return_inverse=True)
        if len(points):
            spelled = np.array([self._spell(int(p)) for p in points], np.int64).reshape(-1, 2)[which]
            self.atom_array = np.array(self.atoms, np.int32)
            rare = self.v.log_weights[self.v.byte_ids[0]] - 12.0
            source, lengths = np.r_[bare, source], np.r_[np.ones(len(bare), np.int64), lengths]
            weight = np.r_[np.full(len(bare), rare), self.v.log_weights[piece]]
            size, piece = np.r_[spelled[:, 1], np.ones(len(piece), np.int64)], np.r_[spelled[:, 0], piece]
        else:
            weight, size = self.v.log_weights[piece], np.ones(len(piece), np.int64)
        order = np.argsort(source, kind="stable")  # by length already
        return source[order], lengths[order], piece[order], size[order], weight[order]

    def add(self, text: np.ndarray, sizes: np.ndarray) -> None:
        """Build the lattices of new distinct units, all together: their code points one after the other, and their lengths."""
        node = len(self.first_edge) - 1
        n_nodes = len(text) + len(sizes)
        chars, lengths, atoms, atom_counts, weight = self._edges(text, sizes)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(sizes)), sizes)[chars]
        source = chars + unit  # each unit before has one more node than characters
        to = source + lengths
        away = ends[unit] - chars
        counts = np.bincount(source, minlength=n_nodes)
        last = np.cumsum(counts)
        after = np.zeros(n_nodes)
        order = np.argsort(away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away, kind="stable")
        levels = np.searchsorted(away[order], np.arange(1, (away.max() if len(away) else 0) + 2))
        w, t, f = weight[order], to[order], source[order]
        for a, b in zip(levels[:-1], levels[1:], strict=True):  # from the last character to the first
            if a < b:
                own = f[a:b]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                after[own[first]] = np.logaddexp.reduceat(w[a:b] + after[t[a:b]], first)
        p = np.exp(weight + after[to] - after[source])
        cum, live, back = p.copy(), np.flatnonzero(counts > 1), 1
        while len(live):  # a node's own sums, edge by edge
            at = last[live] - counts[live] + back
            cum[at] += cum[at - 1]
            back += 1
            live = live[counts[live] > back]
        cum[last[counts > 0] - 1] = 1.0
        more = {
            "root": node + ends - sizes + np.arange(len(sizes)), "first_edge": self.first_edge[-1] + last, "edge_from": source + node, "edge_to": to + node,
            "edge_atoms": atoms, "edge_size": atom_counts, "edge_p": p, "edge_cum": cum,
        }
        for c, x in more.items():
            self._grown[c].extend(x)
        self._show()

    def units_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of the texts, and how many each text has; new units are added."""
        marked = [(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else "" for t in texts]
        codes = code_points("".join(marked))
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(lengths)
        first = np.zeros(len(codes), bool)
        first[(ends - lengths)[lengths > 0]] = True
        if not self.v.crosses:
            space, feed = codes == ord(SPACE), codes == 10
            first |= feed
            first[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(first)
        stops = np.r_[starts[1:], len(codes)]
        hashes = RangeHash(codes).of(starts, stops)
        for i in np.flatnonzero(stops - starts > LONG_UNIT):  # polynomial hashes of long ranges can be made to collide
            hashes[i] = xxhash.xxh64_intdigest(codes[starts[i] : stops[i]])
        found, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.ids) > CACHE_UNITS:
            self.__init__(self.v)
        ids = np.fromiter((self.ids.get(h, -1) for h in found.tolist()), np.int64, len(found))
        new = np.flatnonzero(ids < 0)
        if len(new):
            ids[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self.ids.update(zip(found[new].tolist(), ids[new].tolist(), strict=True))
            sizes = (stops - starts)[at[new]]
            self.add(codes[np.repeat(starts[at[new]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes)
        return ids[which], np.diff(np.searchsorted(starts, np.r_[0, ends]))

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that u falls on."""
        edge = self.first_edge[nodes]
        live = np.flatnonzero(self.edge_cum[edge] < u)
        while len(live):
            edge[live] += 1
            live = live[self.edge_cum[edge[live]] < u[live]]
        return edge

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw from each node to its unit's end: the edges in order of the starts, and the number for each start."""
        live, steps, n, step = np.arange(len(nodes)), [], np.zeros(len(nodes), np.int64), 0
        at = nodes.copy()
        done = self.first_edge[at] == self.first_edge[at + 1]
        live = live[~done]
        while len(live):
            edge = self.draw(at[live], uniform(seeds[live], step))
            steps.append((live, edge))
            n[live] += 1
            at[live] = to = self.edge_to[edge]
            live = live[self.first_edge[to] != self.first_edge[to + 1]]
            step += 1
        out, begin = np.empty(n.sum(), np.int64), np.cumsum(n) - n
        for k, (who, edge) in enumerate(steps):
            out[begin[who] + k] = edge
        return out, n


@dataclass
class Path:
    """A segmentation: its edges, those of them that begin a unit's walk are not told apart."""

    edges: np.ndarray
    log_p: np.ndarray  # of each edge
    value: float  # perturbed
    units: np.ndarray  # the unit of each edge, as a place in the text
    barred: dict[int, list[int]] = field(default_factory=dict)  # edges that a step may not take, because their sets are apart


def truncated(log_mass: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels with these locations, given that they don't exceed ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return log_mass - np.log(-np.log(u) + np.exp(np.minimum(log_mass - bound, 700)))


class Search:
    """The queue of one text: [value, path, step, log mass of the steps before]; the step -1 - t stands for all steps from t on."""

    def __init__(self, lattices: Lattices, seed: int):
        self.l, self.seed, self.queue, self.drawn = lattices, seed, [], 0

    def _others(self, path: Path, steps: np.ndarray) -> np.ndarray:
        """Log-probability of another edge than the path's at each step, given the steps before."""
        left = others(self.l, path.edges[steps])
        for t, out in path.barred.items():
            if len(steps) and steps[0] <= t <= steps[-1]:
                left[t - steps[0]] = self.unbarred(path, t, out)
        return left

    def unbarred(self, path: Path, t: int, out: list[int]) -> float:
        """Log-probability at step t of an edge that is neither the path's nor in ``out``."""
        node = self.l.edge_from[path.edges[t]]
        ways = np.arange(self.l.first_edge[node], self.l.first_edge[node + 1])
        own = self.l.edge_p[ways]
        own[np.array([*out, path.edges[t]]) - ways[0]] = 0.0
        rest = own.sum()
        return float(np.log(rest)) if rest > 0 else -np.inf

    def pop(self) -> tuple[Path, int, float, float] | None:
        """The best set: path, step, log mass of the steps before, value."""
        while self.queue:
            entry = max(self.queue, key=lambda q: q[0].max())
            k = int(entry[0].argmax())
            value, step, path, reach = float(entry[0][k]), int(entry[1][k]), entry[2], float(entry[3][k])
            for i in (0, 1, 3, 4):
                entry[i] = np.delete(entry[i], k)
            if not len(entry[0]):
                self.queue = [q for q in self.queue if q is not entry]
            if step >= 0:
                return path, step, reach, value
            # the group of the later steps: one of its sets attains the value, in proportion to their masses; the others stay below
            first = -1 - step
            steps = np.arange(first, len(path.edges))
            before = reach + np.r_[0.0, np.cumsum(path.log_p[first:])[:-1]]
            mass = before + self._others(path, steps)
            live = np.flatnonzero(np.isfinite(mass))
            share = np.exp(mass[live] - mass[live].max())
            one = live[min(int(np.searchsorted(np.cumsum(share) / share.sum(), uniform(self.seed, 5000, self.drawn))), len(live) - 1)]
            values = truncated(mass, value, uniform(self.seed, 5001 + self.drawn, np.arange(len(mass))))
            self.drawn += 1
            rest = live[live != one]
            if len(rest):
                self.queue.append([values[rest], steps[rest], path, before[rest], mass[rest]])
            return path, int(steps[one]), float(before[one]), value
        return None

    def best_left(self) -> float:
        return max((float(q[0].max()) for q in self.queue), default=-np.inf)


def others(lattices: Lattices, edge: np.ndarray) -> np.ndarray:
    """Log-probability of another edge of each edge's node."""
    node = lattices.edge_from[edge]
    with np.errstate(divide="ignore"):
        return np.where(lattices.first_edge[node + 1] - lattices.first_edge[node] == 1, -np.inf, np.log1p(-np.minimum(lattices.edge_p[edge], 1.0)))


def split_all(lattices: Lattices, searches: list[Search], paths: list[Path], firsts: list[int], befores: list[float], u: np.ndarray) -> None:
    """Queue for each search the sets of paths that leave its path at its first step or later; ``befores`` are the log masses of the steps before."""
    n = len(paths)
    first = np.array(firsts, np.int64)
    stop = np.minimum(first + GROUP, [len(p.edges) for p in paths])
    size = stop - first
    row = np.repeat(np.arange(n), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    reach = np.zeros((n, GROUP + 1))
    reach[row, column + 1] = np.concatenate([p.log_p[a:b] for p, a, b in zip(paths, first, stop, strict=True)])
    np.cumsum(reach, axis=1, out=reach)
    reach += np.array(befores)[:, None]
    mass = np.full((n, GROUP + 1), -np.inf)
    left = others(lattices, np.concatenate([p.edges[a:b] for p, a, b in zip(paths, first, stop, strict=True)]))
    mass[row, column] = reach[row, column] + left
    later = np.array([p.log_p[b:].sum() for p, b in zip(paths, stop, strict=True)])
    some = np.flatnonzero(later < 0)
    mass[some, size[some]] = reach[some, size[some]] + np.log1p(-np.exp(later[some]))
    for i, p in enumerate(paths):
        for t, out in p.barred.items():
            if first[i] <= t < stop[i]:
                mass[i, t - first[i]] = reach[i, t - first[i]] + searches[i].unbarred(p, t, out)
    values = truncated(mass, np.array([p.value for p in paths])[:, None], u)
    steps = np.arange(GROUP + 1) + first[:, None]
    steps[np.arange(n), size] = -1 - stop
    finite = np.isfinite(mass)
    for i, p in enumerate(paths):
        live = np.flatnonzero(finite[i])
        if len(live):
            searches[i].queue.append([values[i, live], steps[i, live], p, reach[i, live], mass[i, live]])


@dataclass
class Sample:
    edges: np.ndarray
    log_p: float
    value: float


def sample_chunk(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """For each text its samples, best first, and the perturbed value that would come next."""
    ids, sizes = lattices.units_of(texts)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - np.repeat(begin, sizes)
    seeds = (uniform(np.repeat(keys, sizes), place) * (1 << 53)).astype(np.uint64)
    edges, n = lattices.walk(lattices.root[ids], seeds)
    with np.errstate(divide="ignore"):
        log_p = np.log(np.maximum(lattices.edge_p[edges], 1e-300))
    of_unit = np.repeat(place, n)
    bounds = np.r_[0, np.cumsum(np.add.reduceat(np.r_[n, 0], begin) * (sizes > 0) if len(n) else np.zeros(len(texts), np.int64))]
    searches, found, paths = [], [], []
    first_u = uniform(keys[:, None], 1, np.arange(GROUP + 1))
    tops = -np.log(-np.log(uniform(keys, 12345)))
    for d in range(len(texts)):
        s = slice(bounds[d], bounds[d + 1])
        path = Path(edges[s], log_p[s], float(tops[d]), of_unit[s])
        searches.append(Search(lattices, int(keys[d])))
        paths.append(path)
        found.append([Sample(path.edges, float(path.log_p.sum()), path.value)])
    if paths:
        split_all(lattices, searches, paths, [0] * len(paths), [0.0] * len(paths), first_u)
    for round_ in range(1, k):
        popped = [(d, p) for d, s in enumerate(searches) if (p := s.pop()) is not None]
        if not popped:
            break
        own_keys = keys[[d for d, _ in popped]]
        turn_u, split_u = uniform(own_keys, 2000 + round_), uniform(own_keys[:, None], 3000 + round_, np.arange(GROUP + 1))
        turns, starts = [], []
        for i, (d, (path, t, _, _)) in enumerate(popped):
            edge = int(path.edges[t])
            node = int(lattices.edge_from[edge])
            ways = np.arange(lattices.first_edge[node], lattices.first_edge[node + 1])
            out = [*path.barred.get(t, []), edge]
            p = lattices.edge_p[ways]
            p[np.array(out) - ways[0]] = 0.0
            c = np.cumsum(p)
            turn = int(ways[min(int(np.searchsorted(c, turn_u[i] * c[-1])), len(ways) - 1)])
            turns.append((turn, out))
            starts.append(np.concatenate([[lattices.edge_to[turn]], lattices.root[ids[begin[d] + int(path.units[t]) + 1 : begin[d] + sizes[d]]]]))
        counts = np.array([len(x) for x in starts])
        units_at = np.array([int(path.units[t]) for _, (path, t, _, _) in popped])
        of_start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - units_at, counts)
        walk_seeds = (uniform(np.repeat(own_keys, counts), 4000 + round_, of_start) * (1 << 53)).astype(np.uint64)
        walked, m = lattices.walk(np.concatenate(starts), walk_seeds)
        with np.errstate(divide="ignore"):
            walked_p = np.log(np.maximum(lattices.edge_p[walked], 1e-300))
        stop = np.cumsum(np.add.reduceat(m, np.cumsum(counts) - counts))
        new_paths = []
        for i, (d, (path, t, reach, value)) in enumerate(popped):
            s = slice(stop[i - 1] if i else 0, stop[i])
            turn, out = turns[i]
            own = np.concatenate([path.edges[:t], [turn], walked[s]])
            turn_p = float(np.log(max(float(lattices.edge_p[turn]), 1e-300)))
            first = np.cumsum(counts)[i] - counts[i]
            unit = int(path.units[t])
            of = np.concatenate([path.units[:t], [unit], np.repeat(np.arange(unit, unit + counts[i]), m[first : first + counts[i]])])
            new_path = Path(own, np.concatenate([path.log_p[:t], [turn_p], walked_p[s]]), value, of, {t: out})
            new_paths.append(new_path)
            found[d].append(Sample(own, float(new_path.log_p.sum()), value))
        split_all(lattices, [searches[d] for d, _ in popped], new_paths, [t for _, (_, t, _, _) in popped], [reach for _, (_, _, reach, _) in popped], split_u)
    return [(f, s.best_left()) for f, s in zip(found, searches, strict=True)]


def pieces_of(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids, with spelled characters in their bytes."""
    size = lattices.edge_size[edges].astype(np.int64)
    shift = np.repeat(lattices.edge_atoms[edges] - (np.cumsum(size) - size), size)
    return lattices.atom_array[shift + np.arange(len(shift))]


def decode_pieces(v: Vocabulary, pieces: np.ndarray) -> bytes:
    """The text that the pieces spell, without the space that encoding put before it."""
    if not len(pieces):
        return b""
    out = v.data_of(pieces)
    return out[1:] if out[:1] == b" " else out


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for i, n in enumerate(pa.compute.utf8_length(batch.column("text")).to_pylist()):
        size += n
        if size >= CHUNK_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(batch):
        yield batch.slice(start)


_lattices: dict[int, Lattices] = {}


def _kept(shared) -> Lattices:
    """The lattices that this worker has built for the broadcast vocabulary; tasks that come later use them again."""
    v = shared.value
    if id(v) not in _lattices:
        _lattices.clear()
        _lattices[id(v)] = Lattices(v)
    return _lattices[id(v)]


def encode_sampled(docs: DataFrame, k: int = K, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, pieces, log_prob, perturbed, inclusion, round_trip): up to k distinct samples for each row, rank 1 first.

    round_trip tells whether decoding the pieces gives the text back.
    """
    import pyarrow.compute  # noqa: F401  pa.compute

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary.load())
    id_type = dict(docs.select(F.col(id_col).alias("x")).dtypes)["x"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        lattices = _kept(shared)
        for batch in batches:
            for part in _chunks(batch):
                texts = part.column("text").to_pylist()
                keys = part.column("key").to_numpy().view(np.uint64)
                found = sample_chunk(lattices, texts, keys, k)
                every = [(d, r + 1, x, after) for d, (samples, after) in enumerate(found) for r, x in enumerate(samples)]
                edges = np.concatenate([x.edges for _, _, x, _ in every]) if every else np.zeros(0, np.int64)
                pieces = pieces_of(lattices, edges)
                ends = np.r_[0, np.cumsum(lattices.edge_size[edges], dtype=np.int64)][np.cumsum([0] + [len(x.edges) for _, _, x, _ in every])]
                spelled = lattices.v.data_of(pieces)
                places = np.r_[0, np.cumsum(lattices.v.sizes[pieces])][ends]
                raw = [b" " + t.encode() if t else b"" for t in texts]
                rows = {
                    "at": [d for d, *_ in every], "rank": [r for _, r, *_ in every], "log_prob": [x.log_p for _, _, x, _ in every], "perturbed": [x.value for _, _, x, _ in every],
                    "inclusion": [-np.expm1(-np.exp(min(x.log_p - after, 700.0))) if np.isfinite(after) else 1.0 for _, _, x, after in every],
                    "round_trip": [spelled[a:b] == raw[d] for (d, *_), a, b in zip(every, places[:-1].tolist(), places[1:].tolist(), strict=True)],
                }
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces.astype(np.int32)))
                yield pa.record_batch(
                    {"doc_id": part.column("doc_id").take(pa.array(rows["at"], pa.int64())), "rank": pa.array(rows["rank"], pa.int32()), "pieces": lists}
                    | {c: rows[c] for c in ("log_prob", "perturbed", "inclusion", "round_trip")}
                )

    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(own, f"doc_id {id_type}, rank int, pieces array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean")


def decode(samples: DataFrame, vocabulary: Vocabulary | None = None, pieces_col: str = "pieces") -> DataFrame:
    """Adds ``text``: what the pieces spell; bytes that aren't UTF-8 become U+FFFD."""
    shared = samples.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    @F.pandas_udf("string")
    def own(pieces):
        return pieces.map(lambda p: decode_pieces(shared.value, np.asarray([] if p is None else p, np.int64)).decode("utf-8", "replace"))

    return samples.withColumn("text", own(F.col(pieces_col)))
