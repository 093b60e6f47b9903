"""SentencePiece BPE encoding with a table of prefixes, and decoding.

The encoding of every prefix of a text ends in one token, and that token alone
determines the rest: the encoding of the prefix before it. An automaton of all
pieces (a trie) reports which tokens end at a place; the one that belongs there is the one
compatible with the last token of the prefix before it, that is, the pair that no
merge across the border would have broken. The table of last tokens is filled from
left to right and the ids are read off backwards.

Only distinct stretches of text are encoded: no piece continues into a new word
mark, and a line feed is no piece, so words are independent; so are the parts of a
word between characters that are side by side in no piece. The table is filled
for many parts at once with numpy, place by place, and read for all of them at once.
"""

from __future__ import annotations

import codecs
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import Memo, map_batches, row_slices, slices, texts_of

MARK = "▁"
_CHARS = 1 << 20
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class PieceModel:
    """What encoding and decoding need to know of a vocabulary."""

    end_id: int
    byte_ids: list[int]
    known: set[str]  # characters that are pieces
    edge_keys: np.ndarray  # prefixes of the pieces, as a table: (prefix, next character) -> longer prefix; 0 is the empty one
    edge_ends: np.ndarray
    token: np.ndarray  # piece that a prefix is, or -1
    lengths: np.ndarray
    rank: np.ndarray  # order of merging: lower merges first
    left: np.ndarray  # the two tokens a piece is merged from last, -1 for single characters
    right: np.ndarray
    whole: np.ndarray  # does the piece encode to itself?
    pair_keys: np.ndarray  # open-addressing table: (left id, right id) -> rank of what they merge to
    pair_ranks: np.ndarray
    adjacent: np.ndarray  # pairs of characters side by side in a piece, in order, and a last value above all
    out: list[bytes]  # text of each id

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two tokens merge to, or a value above all ranks."""
        return _found(self.pair_keys, self.pair_ranks, a, b, _NEVER)


_EMPTY, _NEVER = np.uint64(0xFFFFFFFFFFFFFFFF), np.int64(1) << 40


def _table(entries: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of an open-addressing table."""
    slots = 1 << (2 * len(entries)).bit_length()
    keys, values = np.full(slots, _EMPTY), np.zeros(slots, np.int64)
    shift = 64 - (slots.bit_length() - 1)
    for key, value in entries.items():
        at = (key * int(_PAIR) & 0xFFFFFFFFFFFFFFFF) >> shift
        while keys[at] != _EMPTY:
            at = (at + 1) & (slots - 1)
        keys[at], values[at] = key, value
    return keys, values


def _found(keys: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, without: int) -> np.ndarray:
    """Values of the keys ``a << 32 | b``, or ``without``."""
    key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    slot = ((key * _PAIR) >> np.uint64(64 - (len(keys).bit_length() - 1))).astype(np.int64)
    found = keys[slot]
    todo = np.flatnonzero((found != key) & (found != _EMPTY))
    while len(todo):
        slot[todo] = (slot[todo] + 1) & (len(keys) - 1)
        now = keys[slot[todo]]
        found[todo] = now
        todo = todo[(now != key[todo]) & (now != _EMPTY)]
    return np.where(found == key, values[slot], without)


def _merge(text: str, rank: dict[str, int]) -> list[str]:
    """Plain BPE of one short text: merge the neighbours of least rank, leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        best = min((rank.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if best[0] >= _NEVER:
            break
        i = best[1]
        if len(parts) == 2:
            return [parts[0] + parts[1], *parts]  # the piece and the two it comes from
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in plain}
    ids = {t: i for i, t in text.items()}
    order = {t: k for k, t in enumerate(sorted(ids, key=lambda t: -sp.get_score(ids[t])))}
    rank, lengths = np.zeros(size, np.int64), np.zeros(size, np.int64)
    left, right, whole = np.full(size, -1), np.full(size, -1), np.zeros(size, bool)
    pairs: dict[int, int] = {}
    edges: dict[int, int] = {}
    ends = {}
    for t, i in ids.items():
        rank[i], lengths[i] = order[t], len(t)
        node = 0
        for c in t:
            node = edges.setdefault((node << 32) | ord(c), len(edges) + 1)
        ends[node] = i
        if len(t) == 1:
            whole[i] = True
            continue
        for k in range(1, len(t)):
            a, b = ids.get(t[:k]), ids.get(t[k:])
            if a is not None and b is not None:
                pairs[(a << 32) | b] = order[t]
        made = _merge(t, order)
        if made[0] == t:
            whole[i] = True
            left[i], right[i] = ids[made[1]], ids[made[2]]
    token = np.full(len(edges) + 1, -1)
    token[list(ends)] = list(ends.values())
    adjacent = sorted({(ord(x) << 32) | ord(y) for t in ids for x, y in zip(t, t[1:])})
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    out = [b""] * size
    for i in range(size):
        if i in text:
            out[i] = text[i].replace(MARK, " ").encode()
        elif sp.is_unknown(i):
            out[i] = " ⁇ ".encode()
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    return PieceModel(sp.eos_id(), byte_ids, {t for t in ids if len(t) == 1}, *_table(edges), token, lengths, rank, left, right, whole,
                      *_table(pairs), np.array([*adjacent, np.iinfo(np.int64).max]), out)


def compatible(m: PieceModel, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of tokens: is the encoding of their texts put together those two tokens?

    Takes the merges of both back, latest first. A merge across the border that
    comes before the one just taken back would have been made instead; of equal
    merges the left one is made first.
    """
    fine = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), _NEVER)
    while len(live):
        broken = m.merged_rank(a, b) < limit
        fine[live[broken]] = False
        go = ~broken
        can_a, can_b = m.left[a] >= 0, m.left[b] >= 0
        go &= can_a | can_b
        live, a, b, can_a, can_b = live[go], a[go], b[go], can_a[go], can_b[go]
        back_a = can_a & (~can_b | (m.rank[a] > m.rank[b]))
        limit = np.where(back_a, m.rank[a], m.rank[b] + 1)
        a, b = np.where(back_a, m.right[a], a), np.where(back_a, b, m.left[b])
    return fine


def matches(m: PieceModel, code: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where whole pieces end in a row of characters, and which; none reaches ``limit`` of its first character.

    Follows the prefixes of pieces from all places at once."""
    at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
    stops, tokens = [], []
    while len(at):
        node = _found(m.edge_keys, m.edge_ends, node, code[at], 0)
        live = node > 0
        at, node, limit = at[live], node[live], limit[live]
        token = m.token[node]
        ends = np.flatnonzero(token >= 0)
        ends = ends[m.whole[token[ends]]]
        stops.append(at[ends])
        tokens.append(token[ends])
        at = at + 1
        live = at < limit
        at, node, limit = at[live], node[live], limit[live]
    return np.concatenate([*stops, []]).astype(np.int64), np.concatenate([*tokens, []]).astype(np.int64)


def encode_stretches(m: PieceModel, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts made of known characters only, one after the other, and where those of each text begin and end."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    base = np.cumsum(sizes) - sizes
    code = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
    stop, token = matches(m, code, np.repeat(base + sizes, sizes))
    place = stop - np.repeat(base, sizes)[stop] + 1
    start = place - m.lengths[token]
    last = np.full(int(sizes.sum()), -1)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=0, append=place.max(initial=0) + 1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = order[lo:hi]
        fits = start[at] == 0
        later = np.flatnonzero(~fits)
        before = last[stop[at[later]] - m.lengths[token[at[later]]]]
        reached = before >= 0
        later, before = later[reached], before[reached]
        fits[later[compatible(m, before, token[at[later]])]] = True
        last[stop[at[fits]]] = token[at[fits]]
    ends = np.zeros(len(last), bool)  # does a token of its text's encoding end here?
    at, floor = (base + sizes - 1)[sizes > 0], base[sizes > 0]
    while len(at):
        ends[at] = True
        at = at - m.lengths[last[at]]
        more = at >= floor
        at, floor = at[more], floor[more]
    edges = np.concatenate([[0], np.cumsum(ends)])[np.concatenate([base, [len(last)]])]
    return last[ends].astype(np.uint32), edges


def parts_of(m: PieceModel, marked: list[str]) -> tuple[list[str], list[int]]:
    """Texts cut wherever no piece holds the two characters side by side, and where the parts of each text begin and end.

    No merge crosses such a place, so parts are independent. A character that is no piece is a part by itself."""
    whole = "".join(marked)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
    pair = (code[:-1] << 32) | code[1:]
    base = np.concatenate([[0], np.cumsum([len(s) for s in marked], dtype=np.int64)])
    head = np.ones(len(code) + 1, bool)
    head[1:-1] = m.adjacent[np.searchsorted(m.adjacent[:-1], pair)] != pair
    head[base] = True
    begin = np.flatnonzero(head)
    places = begin.tolist()
    return list(map(whole.__getitem__, map(slice, places[:-1], places[1:]))), np.searchsorted(begin, base).tolist()


def encode_parts(m: PieceModel, parts: list[str]) -> list[bytes]:
    """Ids of :func:`parts_of`, as unsigned 32-bit integers; a character that is no piece becomes bytes."""
    lone = {c: array("I", [m.byte_ids[b] for b in c.encode()]).tobytes() for c in parts if len(c) == 1 and c not in m.known}
    ids, edges = encode_stretches(m, [p for p in parts if p not in lone] if lone else parts)
    data, edges = ids.tobytes(), (edges * ids.itemsize).tolist()
    done = map(data.__getitem__, map(slice, edges[:-1], edges[1:]))
    return [lone[p] if p in lone else next(done) for p in parts] if lone else list(done)


def encode_marked(m: PieceModel, marked: list[str], memo: Memo | None = None) -> list[bytes]:
    """Ids, as unsigned 32-bit integers, of texts in which spaces are marks already; ``memo`` keeps those of parts."""
    parts, edges = parts_of(m, marked)
    each = set(parts)
    known = memo.look_up(each) if memo else dict(zip(each, encode_parts(m, list(each))))
    found = list(map(known.__getitem__, parts))
    return [found[lo] if hi == lo + 1 else b"".join(found[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:])]


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    m = load(path)
    parts = Memo(lambda keys: encode_parts(m, keys))
    return Memo(lambda keys: encode_marked(m, [k if k[0] in MARK + "\n" else MARK + k for k in keys], parts))


_RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


def _keys(text: str) -> list[str]:
    """The independent stretches of a text: words, the mark before them left out where it is one.

    A key that starts with a mark or a line feed stands for itself.
    """
    if not text:
        return []
    if MARK not in text:
        keys = text.replace("\n", " \n").split(" ")
        if "" not in keys:
            return keys
    marked = MARK + text.replace(" ", MARK)
    return _RUNS.findall(marked)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text its ids with the end id."""
    m, memo = load(path), _memo(path)
    end = np.array([m.end_id], np.uint32).tobytes()
    out = []
    for lo, hi in slices(texts, _CHARS):
        keys = [_keys(t) for t in texts[lo:hi]]
        words = memo.look_up(set().union(*keys))
        out += [np.frombuffer(b"".join([words[k] for k in own]) + end, np.uint32) for own in keys]
    return out


@lru_cache(maxsize=2)
def _digits(size: int) -> np.ndarray:
    """Decimal digits of 0 .. size-1 and a space, each padded with zero bytes to the same width."""
    width = len(str(size)) + 1
    return np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)


def decimal(ids: np.ndarray, path: str) -> bytes:
    """Ids in decimal joined by one space."""
    digits = _digits(len(load(path).out))[ids].ravel()
    return digits[digits != 0][:-1].tobytes()


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids: the first mark goes, bytes join to characters, each bad byte becomes U+FFFD.

    Control ids have no text, and bytes on two sides of one do not join.
    """
    m = load(path)
    pieces = list(map(m.out.__getitem__, ids.tolist()))
    edges = [-1, *(i for i, piece in enumerate(pieces) if not piece), len(pieces)] if b"" in pieces else [-1, len(pieces)]
    runs = [b"".join(pieces[lo + 1:hi]) for lo, hi in zip(edges[:-1], edges[1:])]
    runs = [*filter(None, runs[:-1]), runs[-1]]
    heads = (i for i in ids.tolist() if m.out[i])
    if runs[0][:1] == b" " and m.lengths[next(heads)] > 0:
        runs[0] = runs[0][1:]
    return "".join([r.decode("utf-8", "each-bad-byte") for r in runs])


codecs.register_error("each-bad-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``.

    Null texts are empty: they have the end id only. Repeated rows are each
    encoded; other columns are not read.
    """
    def work(batch):
        for part in row_slices(batch, _CHARS):
            n, first, second = [], [], []
            for ids in encode(texts_of(part), path):
                n.append(len(ids))
                first.append(sha256(decimal(ids, path)).hexdigest())
                second.append(sha256(decode(ids, path).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work,
                       f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", scan=True)


def op3_pieces(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs, path)
