"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark tasks.

A task cuts its texts at the pattern's matches. Rows (word, position, token and the one after it) join the merge table, and a
recursive query contracts each word's leftmost pair of least rank until no pair is left. Decoding joins the rows
(document, position, token) with the vocabulary and aggregates their bytes in order of position, from the document's own ids.

The merge table follows from the rank file: a token of rank k is made from every split of it into two tokens. A match that is
itself a token is that token, as the library has it. Matches over ``WINDOW`` bytes go through the same query in windows that
overlap by half and are joined at a token that both have at one place. That is exact: a list of tokens is the encoding of its
bytes if and only if each two neighbours are the encoding of theirs, as the first contraction across a border would happen
between the two neighbours alone as well; and each two neighbours of the joined list stand in one window. Where two
windows have no token in common, the rest is cut anew from a token of the first; where that fails, windows grow.

Cases: null and empty texts have no tokens; characters are never dropped or replaced; repeated rows get equal results; an
empty table gives an empty one. Texts over ``PART`` bytes are cut where a blank follows a letter or a digit, so memory doesn't
grow with them (a single word of many MB stays whole: some 30 bytes of memory for each of its own). Columns of the input other
than the text pass through; the names of the results are parameters and must not be taken.
The vocabulary file is a parameter, read where the tasks run (it is installed there) and never copied.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from covertile.llm.common import map_texts, text_buffers, trim

#: Bytes of a word that the recursive query takes as one; longer ones come in windows of so many.
WINDOW = 48
#: Rows of all steps together that one recursive query may make, about 30 bytes each.
STEP_ROWS = 1 << 22
#: Rows of one decoding query.
DECODE_ROWS = 1 << 18
#: Words that a worker remembers, in each of two generations and over its tasks: some 50 MB at most.
REMEMBERED = 120_000
#: Bytes of a text that are cut into words at once.
PART = 1 << 22
#: The pattern that ``Cutter`` cuts by (fixed value); other patterns go through the regex module.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 30
PLACE = 1 << 32
#: s: a row for each token of each word: its place i, itself, the one after it, and k = rank of the pair x 2^32 + i. g: each word's
#: least k, so the leftmost pair of least rank at place m that becomes token t, and the token n after the pair. The pair's
#: second row goes; the pair and the one before it are looked up again. Words without a pair come once more as done.
ENCODE = f"""
with recursive s(w, i, l, r, k, done) as (
  select w, pos, l, r, coalesce(m.id, {NONE}) * {PLACE} + pos, false
  from (select w, pos, tok as l, lead(tok) over (partition by w order by pos) as r from start) p left join pairs m on m.lr = p.l::bigint * 4294967296 + p.r
  union all
  select q.w, q.i, q.l, q.r, case when q.near then coalesce(m.id, {NONE}) * {PLACE} + q.i else q.k end, q.done
  from (select s.w, case when s.i > g.m then s.i - 1 else s.i end as i, case when s.i = g.m then g.t else s.l end as l,
               case when s.i = g.m then g.n when s.i = g.m - 1 then g.t else s.r end as r, case when s.i > g.m then s.k - 1 else s.k end as k,
               g.m is null as done, coalesce(s.i = g.m or s.i = g.m - 1, false) as near
        from s join (select b.w, b.m, b.t, n.r as n
                     from (select w, case when min(k) < {NONE * PLACE} then (min(k) % {PLACE})::int end as m, (min(k) // {PLACE})::int as t from s where not done group by w) b
                     left join s n on n.w = b.w and n.i = b.m + 1) g on s.w = g.w
        where not s.done and (g.m is null or s.i <> g.m + 1)) q
  left join pairs m on q.near and m.lr = q.l::bigint * 4294967296 + q.r)
select w, l as tok from s where done order by w, i"""
DECODE = "select d, string_agg(v.txt, '' order by pos) as txt from rows join vocab v using (tok) group by d order by d"


class Cutter:
    """Starts of the matches of ``GPT_PATTERN``, found on whole batches by character classes."""

    def __init__(self) -> None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, np.uint8)  # 1 letters, 2 numbers, 3 white space
        for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(p, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                self.kind[a : b + 1] = np.where(self.kind[a : b + 1], self.kind[a : b + 1], k)

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where matches begin in texts that lie one after another."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        if not len(at):
            return at
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cp)
        kind = self.kind[cp]
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        first = first[:n]  # of a text
        last = np.append(first[1:], True)
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        blank = kind == 3
        # the last white space before something else stands alone, or goes with it if it is a plain space
        edge = blank & ~last & ~np.append(blank[1:], True)
        start |= edge
        joined = np.zeros(n, bool)
        joined[1:] = (edge & (cp == 32))[:-1]
        start &= ~joined
        quote = np.flatnonzero((cp == 39) & start)
        room = np.searchsorted(np.flatnonzero(last), quote)
        end = np.flatnonzero(last)[room]
        one = np.where(quote + 1 <= end, cp[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 <= end, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for q, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[q + 1] = False
            after = q + size
            after = after[after < n]
            start[after[~joined[after]]] = True
        return at[start]


class Coder:
    """The tables of one vocabulary in an in-memory DuckDB of one thread, and the words encoded so far."""

    def __init__(self, path: str, pattern: str) -> None:
        self.cutter = Cutter() if pattern == GPT_PATTERN else None
        self.cut = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        l, r, m = [], [], []
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    l.append(a), r.append(b), m.append(rank)
        # all queries are bounded in rows, so nothing has to spill
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self._load("merges", pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "id": pa.array(m, pa.int32())}))
        self.con.execute("create table pairs as select l::bigint * 4294967296 + r as lr, id::bigint as id from merges").fetchall()
        # a byte is held as the character of its number
        self._load("vocab", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "txt": [t.decode("latin-1") for t in ranks]}))
        self.known: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}

    def _load(self, name: str, table: pa.Table) -> None:
        self.con.register("given", table)
        self.con.execute(f"create table {name} as select * from given").fetchall()
        self.con.unregister("given")

    def _ask(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.con.register(name, table)
        got = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return got

    def contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; windows of one word are often equal."""
        each = list(dict.fromkeys(words))
        ids = dict(zip(each, self._contracted(each), strict=True))
        return [ids[w] for w in words]

    def _contracted(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids by the recursive query; words are dealt to queries of bounded numbers of rows."""
        out: list[np.ndarray] = []
        if not words:
            return out
        size = np.array([len(w) for w in words], np.int64)
        part = np.cumsum(size * (size + 1) // 2) // STEP_ROWS
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)], strict=True):
            own = size[a:b]
            start = pa.table({
                "w": np.repeat(np.arange(b - a, dtype=np.int32), own),
                "pos": (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32),
                "tok": self.byte[np.frombuffer(b"".join(words[a:b]), np.uint8)],
            })
            got = self._ask(ENCODE, start=start)
            tok = got["tok"].to_numpy().astype(np.int32)
            out += np.split(tok, np.cumsum(np.bincount(got["w"].to_numpy(), minlength=b - a))[:-1])
        return out

    def learn(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; long ones in windows."""
        long = [i for i, w in enumerate(words) if len(w) > WINDOW]
        spans = {i: _windows(0, len(words[i]), WINDOW) for i in long}
        flat = [w for w in words if len(w) <= WINDOW] + [words[i][a:b] for i in long for a, b in spans[i]]
        each = dict(zip(flat, self.contracted(flat), strict=True))
        out = []
        for i, w in enumerate(words):
            if i not in spans:
                out.append(each[w])
                continue
            ids, failed = self._stitched(spans[i], [each[w[a:b]] for a, b in spans[i]])
            out.append(ids if failed is None else self._anew(w))
        return out

    def _stitched(self, spans: list[tuple[int, int]], coded: list[np.ndarray], first: int = 0) -> tuple[np.ndarray, tuple[int, int] | None]:
        """(ids, None), or (ids that are final, (window, its first token in use)) where a window and the next have no token in common.

        ``first``: the first window's token that the result begins with.
        """
        out, at = [], first
        starts = spans[0][0] + np.append(0, np.cumsum(self.size[coded[0]]))[:-1]
        for n in range(1, len(spans)):
            nxt = spans[n][0] + np.append(0, np.cumsum(self.size[coded[n]]))[:-1]
            # tokens of both that begin at one place and are the same
            _, x, y = np.intersect1d(starts[at:], nxt, assume_unique=True, return_indices=True)
            same = np.flatnonzero(coded[n - 1][at:][x] == coded[n][y])
            if not len(same):
                return np.concatenate([*out, np.zeros(0, np.int32)]), (n - 1, at)
            i, j = int(x[same[0]]) + at, int(y[same[0]])
            out.append(coded[n - 1][at:i])
            starts, at = nxt, j
        return np.concatenate([*out, coded[-1][at:]]), None

    def _anew(self, word: bytes) -> np.ndarray:
        """A long word whose windows didn't join: cut anew from a token's start wherever that happens, with larger windows in the end."""
        size = 2 * WINDOW
        while True:
            done, pos, held, take = [], 0, None, 64
            while True:
                spans = _windows(pos, len(word), size)[:take]
                coded = self.contracted([word[a:b] for a, b in spans])
                if held is not None:
                    spans, coded = [held[0], *spans], [held[1], *coded]
                ids, failed = self._stitched(spans, coded, held[2] if held else 0)
                if failed is None and spans[-1][1] == len(word):
                    return np.concatenate([*done, ids])
                last, at = failed if failed is not None else self._last(spans, coded, held[2] if held else 0)
                if failed is not None and held is not None and last == 0:
                    break  # not even from a token's start
                starts = spans[last][0] + np.append(0, np.cumsum(self.size[coded[last]]))[:-1]
                after = starts[at:][starts[at:] >= (spans[last][0] + spans[last][1]) // 2]
                if not len(after):
                    break
                done.append(ids if failed is not None else ids[: len(ids) - (len(coded[last]) - at)])
                pos, held, take = int(after[0]), (spans[last], coded[last], at), 64 if failed is not None else 2 * take
            size *= 2

    def _last(self, spans: list[tuple[int, int]], coded: list[np.ndarray], first: int) -> tuple[int, int]:
        """The last window and its first token in use, where all of them joined."""
        if len(spans) == 1:
            return 0, first
        ids, _ = self._stitched(spans[-2:], coded[-2:])
        before = np.append(0, np.cumsum(self.size[coded[-2]]))[:-1] + spans[-2][0]
        nxt = np.append(0, np.cumsum(self.size[coded[-1]]))[:-1] + spans[-1][0]
        _, x, y = np.intersect1d(before, nxt, assume_unique=True, return_indices=True)
        same = np.flatnonzero(coded[-2][x] == coded[-1][y])
        return len(spans) - 1, int(y[same[0]])

    def pieces(self, found: list[bytes]) -> list[np.ndarray]:
        """The ids of each distinct match."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        out: dict[bytes, np.ndarray] = {}
        new = []
        for p in found:
            x = self.known.get(p)
            if x is None and (x := self.older.get(p)) is not None:
                self.known[p] = x
            if x is None and (t := self.ranks.get(p)) is not None:
                x = np.array([t], np.int32)
            if x is None:
                new.append(p)
            else:
                out[p] = x
        made = dict(zip(new, self.learn(new), strict=True))
        # views would keep all of a query's ids
        self.known.update((p, x.copy()) for p, x in made.items() if len(p) <= WINDOW)
        out |= made
        return [out[p] for p in found]

    def _starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.cutter is not None:
            return self.cutter.starts(raw, offsets).astype(np.int64)
        starts = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            t = raw[a:b].tobytes().decode()
            sizes = np.cumsum([0, *(len(m[0].encode()) for m in self.cut.finditer(t))])
            starts.append(a + sizes[:-1])
        return np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)

    def _parts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``offsets`` and, in texts over ``PART`` bytes, places where a blank follows an ASCII letter or digit: a match begins there."""
        more = [offsets]
        if self.cutter is not None:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at = a
                while b - at > PART:
                    for lo in range(at + PART, b, PART):
                        own = raw[lo - 1 : min(lo + PART, b)]
                        low = own[:-1] | 32
                        hit = np.flatnonzero((own[1:] == 32) & (((low >= 97) & (low <= 122)) | ((own[:-1] >= 48) & (own[:-1] <= 57))))
                        if len(hit):
                            break
                    else:
                        break
                    at = lo + int(hit[0])
                    more.append(np.array([at]))
        return np.sort(np.concatenate(more))

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): all texts' ids one after another, and where each text's begin and end."""
        raw, offsets = text_buffers(texts)
        ids, count = [], np.zeros(len(texts) + 1, np.int64)
        parts = self._parts(raw, offsets)
        at = 0
        while at < len(parts) - 1:
            # parts of about PART bytes together
            end = max(at + 1, int(np.searchsorted(parts, parts[at] + PART, "right")) - 1)
            lo, hi = int(parts[at]), int(parts[end])
            own = raw[lo:hi]
            starts = self._starts(own, parts[at : end + 1] - lo)
            ends = np.append(starts, hi - lo)
            cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(own))]).dictionary_encode()
            coded = self.pieces(cut.dictionary.to_pylist())
            n = np.array([len(x) for x in coded], np.int64)
            word = cut.indices.to_numpy().astype(np.int64)
            if len(word):
                flat, first, each = np.concatenate(coded), np.cumsum(n) - n, n[word]
                ids.append(flat[np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
                text = np.searchsorted(offsets, starts + lo, "right") - 1
                count[1:] += np.bincount(text, each, len(texts)).astype(np.int64)
            at = end
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.cumsum(count)

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> Iterator[bytes]:
        """The bytes of each list of ids, in order. Queries have ``DECODE_ROWS`` rows; a longer list is decoded part by part."""
        held: list[str] = []
        text, n = 0, len(cuts) - 1
        for a in range(0, len(ids), DECODE_ROWS):
            own = ids[a : a + DECODE_ROWS]
            d = np.searchsorted(cuts, np.arange(a, a + len(own)), "right") - 1
            got = self._ask(DECODE, rows=pa.table({"d": d.astype(np.int32), "pos": np.arange(len(own), dtype=np.int32), "tok": own}))
            for i, txt in zip(got["d"].to_pylist(), got["txt"].to_pylist(), strict=True):
                while text < i:
                    yield "".join(held).encode("latin-1")
                    held, text = [], text + 1
                held.append(txt)
        while text < n:
            yield "".join(held).encode("latin-1")
            held, text = [], text + 1


def _windows(a: int, n: int, size: int) -> list[tuple[int, int]]:
    """Windows of ``size`` bytes over a..n that overlap by half."""
    last = max(1, -(-(n - a) // (size // 2)) - 1)
    return [(a + k * (size // 2), min(n, a + k * (size // 2) + size)) for k in range(last)]


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """``docs`` without its text, with the column ``into`` (array<int>)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        ids, cuts = coder(path, pattern).code(texts)
        return [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))]

    return map_texts(docs, run, f"{into} array<int>", done=trim)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with ``into`` (binary), the bytes of the column ``ids``; null ids decode to nothing."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(ids)
            cuts = np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            back = list(coder(path, pattern).decode(col.flatten().to_numpy(zero_copy_only=False).astype(np.int32), cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*kept, into])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{into}` binary"]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded, then each text's ids decoded."""

    def run(texts: pa.Array) -> list[pa.Array]:
        c = coder(path, pattern)
        ids, cuts = c.code(texts)
        raw = ids.astype("<u4").tobytes()
        own = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return [pa.array(np.diff(cuts)), pa.array(own, pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in c.decode(ids, cuts)], pa.string())]

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", done=trim)
