"""Token counts of a byte-fallback piece vocabulary through a deterministic transducer.

A pair-merging tokenizer (always join the best-scored adjacent pair, leftmost first) has two
properties this module compiles into a transducer over characters:

* an encoding is the right one exactly when each pair of neighbouring pieces is the encoding of
  its own concatenation, so the last piece of every prefix of a text is determined by the last
  pieces of shorter prefixes;
* no merge crosses a character bigram that no piece contains, so such a bigram sends the
  transducer to a state that depends on the second character alone (a synchronising bigram).

A state is the window of recent positions that some later piece can still reach back to, each
with the last piece of its prefix and its count relative to the newest prefix.  A transition on
a character carries the change of the token count.  States and transitions are compiled on
first use and kept for the life of the worker.

Texts are cut into chunks of equal length.  A chunk's state map is a head, the characters before
its first synchronising bigram, and a tail that leads to the same state with the same count
whatever the chunk was entered with.  Maps compose associatively (a map without tail
concatenates its head with the next), so a prefix scan over the chunks gives every entry state;
all tails run in step through the compiled table, then all heads.

A long run without such a bigram is cut into pieces whose maps are worked out over the states that can enter them: those that
short warm-ups before the piece end in, what the piece before leads these to, and every state found anywhere else whose
remembered characters stand before the piece, until nothing new is met.  The maps, states to states with counts, compose by
doubling, so no run is one lane however long it is.
"""

from __future__ import annotations

import heapq

import numpy as np

SPACE = "▁"
OFFSET = 32  # added to a count change so that it fits in the low bits of a packed transition
BITS = 6
GONE = ("", 0)
IDLE = 0  # the column of steps that do nothing
LONG = 1024  # characters from which a run without a synchronising bigram is cut
PIECE = 256
WARM = 48  # characters of the longest warm-up
WARM_UPS = 16  # before each piece, each a character shorter


class PieceTransducer:
    def __init__(self, pieces: list[tuple[str, float]], add_dummy_prefix: bool = True, max_states: int = 200_000):
        """``pieces``: (surface, score) of the ordinary pieces; control and byte pieces are left out."""
        self.score = dict(pieces)
        self.prefix = add_dummy_prefix
        self.max_states = max_states
        self.max_len = max(map(len, self.score), default=1)
        self.starts = {p[:i] for p in self.score for i in range(1, len(p))}
        self.bigrams = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        chars = sorted({c for p in self.score for c in p})
        self.class_of = {c: i + 1 for i, c in enumerate(chars)}  # 0: a character in no piece
        self.chars = [""] + chars
        self.table_of_codes = np.zeros(0x110000, dtype=np.int32)
        for c, i in self.class_of.items():
            self.table_of_codes[ord(c)] = i
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces_of: dict[str, tuple[str, ...]] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets the compiled part, and what was learnt on the way."""
        self.pairs.clear()
        self.pieces_of.clear()
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.column = np.full(len(self.chars), -1, dtype=np.int32)  # class -> column, on first use
        self.of_column: list[int] = [-1]  # the first is IDLE
        self.table = np.full((256, 32), -1, dtype=np.int32)
        self.start = self._state(((None, 0),), "")

    # -- compilation ------------------------------------------------------------------------

    def encode(self, s: str) -> tuple[str, ...]:
        """The merges themselves, for short strings."""
        got = self.pieces_of.get(s)
        if got is not None:
            return got
        sym, nxt, prv = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = [(-v, i, s[i : i + 2]) for i in range(len(s) - 1) if (v := self.score.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j >= len(s) or len(sym[i]) + len(sym[j]) != len(joined) or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j], nxt[i] = joined, None, nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < len(s) and (v := self.score.get(sym[a] + sym[b])) is not None:
                    heapq.heappush(heap, (-v, a, sym[a] + sym[b]))
        out = tuple(x for x in sym if x is not None)
        if len(s) <= self.max_len:
            self.pieces_of[s] = out
        return out

    def _fits(self, left: str | None, piece: str) -> bool:
        if left is None:
            return True
        ok = self.pairs.get((left, piece))
        if ok is None:
            ok = self.pairs[left, piece] = self.encode(left + piece) == (left, piece)
        return ok

    def _state(self, window: tuple, tail: str) -> int:
        """window: (last piece, count less the newest prefix's) of the last len(tail)+1 prefixes, oldest first."""
        key = (window, tail)
        if (i := self.ids.get(key)) is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return i

    def step(self, state: int, cls: int) -> int:
        """The packed transition: next state and count change."""
        window, tail = self.states[state]
        if cls == 0:  # emitted as bytes, whose number the caller adds; nothing merges with it
            return self.start << BITS | OFFSET
        c = self.chars[cls]
        if tail and tail[-1] + c not in self.bigrams:
            window, tail = ((None, 0),), ""
        s, score, starts = tail + c, self.score, self.starts
        n = len(s)
        for i in range(n - 1, -1, -1):
            piece = s[i:]
            if piece in score:
                left, count = window[i]
                if left != "" and len(self.encode(piece)) == 1 and self._fits(left, piece):
                    break
        change = count + 1
        # A position that no longer piece can begin at is never asked again: those before the first other go, the rest look the same.
        moved = [(w[0], w[1] - change) if w is not GONE and s[i:] in starts else GONE for i, w in enumerate(window)]
        keep = next((i for i, w in enumerate(moved) if w is not GONE), n)
        return self._state((*moved[keep:], (piece, 0)), s[keep:]) << BITS | change + OFFSET

    # -- evaluation -------------------------------------------------------------------------

    def _columns(self, classes: np.ndarray) -> np.ndarray:
        cols = self.column[classes]
        if cols.size and cols.min() < 0:
            for cls in np.unique(classes[cols < 0]).tolist():
                self.column[cls] = len(self.of_column)
                self.of_column.append(cls)
            while self.table.shape[1] < len(self.of_column):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            names = [self.chars[cls] if cls > 0 else "" for cls in self.of_column]
            self.merges = np.array([[bool(a and b) and a + b in self.bigrams for b in names] for a in names])
            cols = self.column[classes]
        return cols

    def _advance(self, state: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Packed transitions, compiled where they are missing."""
        packed = self.table.reshape(-1).take(state * self.table.shape[1] + cols)
        while packed.size and packed.min() < 0:
            miss = packed < 0
            for k, s in set(zip(cols[miss].tolist(), state[miss].tolist(), strict=True)):
                to = 0 << BITS | OFFSET if k == IDLE else self.step(s, self.of_column[k])
                self.table[s, k] = to
            packed = self.table.reshape(-1).take(state * self.table.shape[1] + cols)
        return packed

    def _run(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the spans [begin, end) in step from their states: end states and counts. Idle steps lead back to the start."""
        order = np.argsort(begin - end, kind="stable")  # longest first, so that those still running are a prefix
        at, lengths, st = begin[order], (end - begin)[order], state[order].astype(np.int32)
        ct = np.zeros(len(order), dtype=np.int32)
        steps = int(lengths[0]) if len(lengths) else 0
        for lo in range(0, steps, 64):
            live = int(np.searchsorted(-lengths, -lo, side="left"))
            where = at[:live, None] + np.arange(lo, min(lo + 64, steps))
            block = np.ascontiguousarray(cols.take(where, mode="clip").T)
            for k in range(len(block)):
                live = int(np.searchsorted(-lengths, -(lo + k), side="left"))
                packed = self._advance(st[:live], block[k, :live])
                np.right_shift(packed, BITS, out=st[:live])
                ct[:live] += (packed & (1 << BITS) - 1) - OFFSET
        out, count = np.empty_like(st), np.empty(len(order), dtype=np.int64)
        out[order], count[order] = st, ct
        return out, count

    def _counted(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Counts of the spans from their states: short ones in step, long ones through the maps of their pieces."""
        count = np.zeros(len(begin), dtype=np.int64)
        long = end - begin > LONG
        _, count[~long] = self._run(cols, begin[~long], end[~long], state[~long])
        if long.any():
            count[long] = self._composed(cols, begin[long], end[long], state[long])
        return count

    def _composed(self, cols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        per = -(-(end - begin) // PIECE)
        first = np.cumsum(per) - per
        span = np.repeat(np.arange(len(per)), per)
        at = begin[span] + (np.arange(len(span)) - first[span]) * PIECE
        stop = np.minimum(at + PIECE, end[span])
        inner = np.setdiff1d(np.arange(len(span)), first)  # pieces with another before them
        before = {int(j): "".join(self.chars[c] if c > 0 else "" for c in (self.of_column[k] for k in cols[max(0, at[j] - self.max_len) : at[j]])) for j in inner}
        by_suffix: dict[int, dict[str, list[int]]] = {}

        def entered(s: int) -> list[int]:
            """The pieces before which the state's characters stand."""
            tail = self.states[s][1]
            if len(tail) not in by_suffix:
                told = by_suffix[len(tail)] = {}
                for j, text in before.items():
                    told.setdefault(text[len(text) - len(tail) :], []).append(j)
            return by_suffix[len(tail)].get(tail, [])

        # Nodes are (piece, state that it is entered with).
        node: dict[tuple[int, int], int] = {}
        pieces, states, ends, counts = [], [], [], []
        warm_at = (at[inner][:, None] - WARM + np.arange(WARM_UPS)).ravel()
        warm_to = np.repeat(at[inner], WARM_UPS)
        ended, _ = self._run(cols, warm_at, warm_to, np.full(len(warm_at), self.start, dtype=np.int64))
        new = list(dict.fromkeys([*zip(first.tolist(), state.tolist(), strict=True), *zip(np.repeat(inner, WARM_UPS).tolist(), ended.tolist(), strict=True)]))
        last = set((first + per - 1).tolist())
        spread: set[int] = set()
        while new:
            for n in new:
                node[n] = len(node)
            j, s = (np.array(x, dtype=np.int64) for x in zip(*new, strict=True))
            to, n_tokens = self._run(cols, at[j], stop[j], s)
            pieces += j.tolist()
            states += s.tolist()
            ends += to.tolist()
            counts += n_tokens.tolist()
            met = dict.fromkeys((a + 1, b) for a, b in zip(j.tolist(), to.tolist(), strict=True) if a not in last)
            for b in {b for _, b in met} - spread:
                spread.add(b)
                met.update(dict.fromkeys((a, b) for a in entered(b)))
            new = [n for n in met if n not in node]
        nxt = np.array([-1 if j in last else node[j + 1, e] for j, e in zip(pieces, ends, strict=True)], dtype=np.int64)
        total = np.array(counts, dtype=np.int64)
        while (nxt >= 0).any():  # maps of twice as many pieces at each step
            on = nxt >= 0
            total[on] += total[nxt[on]]
            nxt[on] = nxt[nxt[on]]
        return total[[node[n] for n in zip(first.tolist(), state.tolist(), strict=True)]]

    def counts(self, texts: list[str], chunk: int = 256) -> np.ndarray:
        """Tokens of each text: none for an empty one."""
        if len(self.states) > self.max_states:
            self.reset()
        out = np.zeros(len(texts), dtype=np.int64)
        head = SPACE if self.prefix else ""
        kept = [(i, head + t.replace(" ", SPACE)) for i, t in enumerate(texts) if t]
        if not kept:
            return out
        lengths = np.array([len(t) for _, t in kept], dtype=np.int64)
        codes = np.frombuffer("".join(t for _, t in kept).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = self.table_of_codes[codes]
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        # Characters of no piece are emitted as bytes.
        unknown = np.flatnonzero(classes == 0)
        if unknown.size:
            c = codes[unknown]
            size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            np.add.at(out, np.array([i for i, _ in kept])[np.searchsorted(first, unknown, side="right") - 1], size)
        cols = self._columns(classes)
        joined = np.zeros(len(codes), dtype=bool)  # whether a merge can cross the border before a character
        joined[1:] = self.merges.reshape(-1).take(cols[:-1] * self.merges.shape[1] + cols[1:])
        joined[first] = False
        # Chunks, each text's own: their heads end at the first border that no merge crosses.
        per = -(-lengths // chunk)
        text_of = np.repeat(np.arange(len(kept)), per)
        begin = first[text_of] + (np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)) * chunk
        end = np.minimum(begin + chunk, (first + lengths)[text_of])
        borders = np.flatnonzero(~joined)
        sync = borders[np.minimum(np.searchsorted(borders, begin), len(borders) - 1)]
        sync = np.where((sync < begin) | (sync >= end), end, sync)
        closed = sync < end
        start = np.full(int(closed.sum()), self.start, dtype=np.int64)
        tail_state, tail_count = self._run(cols, sync[closed], end[closed], start)
        # Prefix scan: a chunk without tail lengthens the head of the next; every head is entered with the last tail's state.
        source = np.flatnonzero(closed)
        following = np.append(source[1:], len(closed))
        head_end = np.where(following < len(closed), sync[np.minimum(following, len(closed) - 1)], len(codes))
        same = np.zeros(len(source), dtype=bool)
        same[:-1] = text_of[source[1:]] == text_of[source[:-1]]
        head_end = np.where(same, head_end, (first + lengths)[text_of[source]])
        head_count = self._counted(cols, end[closed], head_end, tail_state)
        np.add.at(out, np.array([i for i, _ in kept])[text_of[source]], tail_count + head_count)
        return out


def from_sentencepiece(path: str) -> PieceTransducer:
    """The ordinary pieces and scores of a model file; user-defined pieces are refused, as they match before any merge."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((sp.id_to_piece(i), sp.get_score(i)))
    return PieceTransducer(pieces)
