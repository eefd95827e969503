"""Deeply nested records to linked flat rows, by vectorised structural indexing.

A batch of JSON texts is one byte buffer.  Bitmaps of quotes (backslash runs of odd length
taken off), of brackets and of delimiters outside strings are made for the whole buffer at
once; running sums of the bitmaps give string parity and nesting depth, restarted at each
record.  Every token then finds its enclosing bracket by one binary search over the opening
brackets ordered by depth, which yields parent links, keys and positions without walking any
record.  A record whose tokens do not follow the grammar of JSON is unreadable as a whole.

Paths treat a list and a single value in its place alike: the elements of a list have the
path of the list, and a single value stands at position 0.

Cases: NULL, empty, blank and broken texts, and texts that hold a bare scalar, give no rows;
a text wrapped in JSON strings any number of times is unwrapped; empty lists and NULL entries
give no rows but keep their positions; repeated keys are all read; records may be of any
length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_QUOTE, _SLASH, _COLON, _COMMA = b'"\\:,'
_OPEN, _CLOSE = b"{[", b"}]"
_NUMBER = re.compile(rb"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)\Z")
# Kinds of byte: blank, structural mark, quote, anything else.
_KIND = np.full(256, 3, np.uint8)
_KIND[list(b" \t\r\n")] = 0
_KIND[list(b"{}[]:,")] = 1
_KIND[_QUOTE] = 2
_ESCAPED, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrt')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)] = 1
_STEP[list(_CLOSE)] = -1
_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_CHUNK = 4 << 20


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, 0 for an empty one."""
    out = np.zeros(len(start), np.uint64)
    some = np.flatnonzero(end > start)
    if len(some):
        size = (end - start)[some]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        within = np.arange(size.sum()) - np.repeat(first, size)
        byte = data[np.repeat(start[some], size) + within].astype(np.uint64)
        out[some] = np.add.reduceat((byte + np.uint64(1)) * _WEIGHTS[within % 4096], first)
    return out


def _hash_key(key: str) -> np.uint64:
    raw = np.frombuffer(key.encode("utf-8", "surrogatepass"), np.uint8)
    return _hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]


def _step_path(path: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (path ^ (key * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def path_hash(path: str | None) -> np.uint64:
    """The hash of a dotted path from the root; the root itself is 1."""
    out = np.array([1], np.uint64)
    for key in (path or "").split(".") if path else []:
        out = _step_path(out, np.array([_hash_key(key)]))
    return out[0]


@dataclass
class Index:
    """The values of a batch: record, parent (-1: none), position, path and span of each; ``readable`` is per record."""

    data: np.ndarray
    readable: np.ndarray
    record: np.ndarray
    parent: np.ndarray
    position: np.ndarray
    path: np.ndarray
    mark: np.ndarray
    start: np.ndarray
    end: np.ndarray
    depth: np.ndarray


def index(data: np.ndarray, offsets: np.ndarray) -> Index:
    """Index the JSON texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # quotes that no backslash escapes
    quote = data == _QUOTE
    slash = np.flatnonzero(data == _SLASH)
    if len(slash):
        new = np.ones(len(slash), bool)
        new[1:] = np.diff(slash) > 1
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        first = slash[np.flatnonzero(new)]
        ends = offsets[np.searchsorted(offsets, first, "right")]  # a text cut behind a backslash escapes nothing in the next one
        after = first + size
        after = after[(size % 2 == 1) & (after < ends)]
        quote[after] = False
        # what an escape may stand before: one of a few marks, or u and four hexadecimal digits
        follows = np.zeros((len(after), 5), np.uint8)
        for i in range(5):
            there = after + i < len(data)
            follows[there, i] = data[after[there] + i]
        fine = _ESCAPED[follows[:, 0]] | ((follows[:, 0] == ord("u")) & _HEX[follows[:, 1:]].all(axis=1))
        false_escape = after[~fine]
    else:
        false_escape = slash
    # string parity, restarted at each record
    parity = np.bitwise_xor.accumulate(quote.view(np.uint8)) if len(data) else quote.view(np.uint8)
    base = np.zeros(n, np.uint8)
    inner = offsets[:-1] > 0
    base[inner] = parity[offsets[:-1][inner] - 1]
    inside = (parity ^ np.repeat(base, lengths)).astype(bool)
    bad = np.zeros(n, bool)
    some = lengths > 0
    bad[~some] = True
    bad[some] |= inside[offsets[1:][some] - 1]

    kind = _KIND[data]
    outside = ~inside
    plain = outside & (kind == 3)
    begin = plain.copy()
    begin[1:] &= ~plain[:-1]
    starts = offsets[:-1][some]
    begin[starts] = plain[starts]
    control = np.concatenate([np.flatnonzero(inside & (data < 32)), false_escape])
    token = np.flatnonzero((outside & (kind == 1)) | (quote & inside) | begin)
    bounds = np.searchsorted(token, offsets)
    record = np.repeat(np.arange(n), np.diff(bounds))
    mark = data[token]
    if len(control):
        bad[np.searchsorted(offsets, control, "right") - 1] = True
    t = len(token)
    if not t:
        none = np.zeros(0, np.int64)
        return Index(data, ~bad & False, none, none, none, none.astype(np.uint64), mark, none, none, none)
    bad[np.diff(bounds) == 0] = True

    structural = kind[token] == 1
    step = np.where(structural, _STEP[mark], 0).astype(np.int32)
    depth = np.cumsum(step)
    ground = np.concatenate([[0], depth])[bounds[:-1]]
    depth -= np.repeat(ground, np.diff(bounds)).astype(depth.dtype)
    np.logical_or.at(bad, record[depth < 0], True)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    bad[record[last[depth[last] != 0]]] = True

    is_open, is_close = structural & (step > 0), structural & (step < 0)
    is_colon, is_comma = structural & (mark == _COLON), structural & (mark == _COMMA)
    is_string = ~structural & (mark == _QUOTE) & quote[token]
    is_plain = ~structural & ~is_string
    level = np.where(is_open, depth - 1, np.where(is_close, depth + 1, depth))  # how many brackets enclose it; a closing one counts as inside its own
    opens = np.flatnonzero(is_open)
    ranked = np.sort(depth[opens].astype(np.int64) * (t + 1) + opens)
    parent = np.full(t, -1, np.int64)
    if len(opens):
        asked = np.flatnonzero(level > 0)
        want = level[asked].astype(np.int64) * (t + 1) + asked
        at = ranked[np.maximum(np.searchsorted(ranked, want) - 1, 0)]
        found = at % (t + 1)
        good = (at // (t + 1) == level[asked]) & (record[found] == record[asked]) & (found < asked)
        parent[asked[good]] = found[good]
        np.logical_or.at(bad, record[asked[~good]], True)

    # grammar: what may stand before each token, given its bracket
    held = np.where(parent >= 0, mark[np.maximum(parent, 0)], 0)
    in_object, in_list, top = held == _OPEN[0], held == _OPEN[1], parent < 0
    same_before = np.zeros(t, bool)
    same_before[1:] = record[1:] == record[:-1]
    roll = lambda x: np.concatenate([[False], x[:-1]]) & same_before
    same_after = np.concatenate([same_before[1:], [False]])
    is_key = is_string & in_object & np.concatenate([is_colon[1:], [False]]) & same_after
    value = is_open | is_plain | (is_string & ~is_key)
    ended = is_close | is_plain | (is_string & ~is_key)  # a value may end here
    p_open, p_comma, p_colon, p_key, p_end = roll(is_open), roll(is_comma), roll(is_colon), roll(is_key), roll(ended)
    own = np.concatenate([[-1], np.arange(t - 1)]) == parent  # directly behind its opening bracket
    ok = np.zeros(t, bool)
    ok |= value & top & ~same_before
    ok |= value & in_object & p_colon
    ok |= value & in_list & ((p_open & own) | p_comma)
    ok |= is_key & ((p_open & own) | p_comma)
    ok |= is_colon & p_key & in_object
    ok |= is_comma & p_end & ~top
    ok |= is_close & (p_end | (p_open & own)) & np.where(mark == _CLOSE[0], in_object, in_list)
    np.logical_or.at(bad, record[~ok], True)

    # spans
    start, end = token.astype(np.int64), np.full(t, -1, np.int64)
    quotes = np.flatnonzero(quote)
    s = np.flatnonzero(is_string)
    closing = np.minimum(np.searchsorted(quotes, token[s]) + 1, len(quotes) - 1)
    start[s], end[s] = token[s] + 1, quotes[closing] if len(s) else 0
    q = np.flatnonzero(is_plain)
    if len(q):
        stops = np.concatenate([plain[1:], [False]])
        finish = plain & ~stops
        finish[offsets[1:][some] - 1] |= plain[offsets[1:][some] - 1]
        ends = np.flatnonzero(finish)
        end[q] = ends[np.searchsorted(ends, token[q])] + 1
        text = data.tobytes()
        seen: dict[bytes, bool] = {}
        wrong = []
        for i, a, b in zip(q.tolist(), start[q].tolist(), end[q].tolist()):
            w = text[a:b]
            fine = seen.get(w)
            if fine is None:
                fine = bool(_NUMBER.match(w))
                if len(seen) < 100_000:
                    seen[w] = fine
            if not fine:
                wrong.append(i)
        bad[record[wrong]] = True

    # values only, of readable records
    keep = value & ~bad[record]
    nodes = np.flatnonzero(keep)
    number = np.full(t, -1, np.int64)
    number[nodes] = np.arange(len(nodes))
    up = np.where(parent[nodes] >= 0, number[np.maximum(parent[nodes], 0)], -1)
    order = np.argsort(up, kind="stable")
    first = np.ones(len(nodes), bool)
    first[1:] = up[order][1:] != up[order][:-1]
    rank = np.arange(len(nodes)) - np.maximum.accumulate(np.where(first, np.arange(len(nodes)), 0)) if len(nodes) else np.zeros(0, np.int64)
    position = np.zeros(len(nodes), np.int64)
    position[order] = rank
    keyed = in_object[nodes]
    position[~in_list[nodes]] = 0
    key = np.zeros(len(nodes), np.uint64)
    k = nodes[keyed] - 2
    key[keyed] = _hash_spans(data, start[k], end[k])
    escaped = np.flatnonzero(np.searchsorted(slash, end[k]) > np.searchsorted(slash, start[k])) if len(slash) else []
    for i, a, b in zip(escaped, start[k][escaped].tolist(), end[k][escaped].tolist()):
        key[np.flatnonzero(keyed)[i]] = _hash_key(json.loads(b'"' + data[a:b].tobytes() + b'"')) if b > a else 0
    path = np.ones(len(nodes), np.uint64)
    levels = level[nodes]
    for d in range(1, int(levels.max()) + 1 if len(nodes) else 0):
        here = levels == d
        o, li = here & keyed, here & ~keyed
        path[o] = _step_path(path[up[o]], key[o])
        path[li] = path[up[li]]
    return Index(data, ~bad, record[nodes], up, position, path, mark[nodes], start[nodes], end[nodes], levels.astype(np.int64))


def _texts(ix: Index, nodes: np.ndarray) -> list[str]:
    """The text of string values, escapes resolved."""
    raw = ix.data.tobytes() if len(nodes) > 64 else ix.data
    out = []
    for a, b in zip(ix.start[nodes].tolist(), ix.end[nodes].tolist()):
        s = bytes(raw[a:b])
        out.append(json.loads(b'"' + s + b'"') if b"\\" in s else s.decode("utf-8", "replace"))
    return out


@dataclass(frozen=True)
class Level:
    """A list inside a record: its dotted path from the root, and below it the path of the text wanted ("" where the entry is the text).

    ``where`` keeps only entries of which the text at a path below them has a given value.
    """

    outer: str | None
    inner: str
    name: str = ""
    where: tuple[str, str] | None = None


def _climb(ix: Index, nodes: np.ndarray, target: np.uint64) -> np.ndarray:
    """The nearest value at or above each node whose path is ``target``; -1 if there is none."""
    at = nodes.copy()
    for _ in range(int(ix.depth.max()) + 1 if len(ix.depth) else 0):
        go = (at >= 0) & (ix.path[np.maximum(at, 0)] != target)
        if not go.any():
            break
        at[go] = ix.parent[at[go]]
    at[(at >= 0) & (ix.path[np.maximum(at, 0)] != target)] = -1
    return at


def linked(ix: Index, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(record, outer position, inner position, text) of each non-empty text at ``level``."""
    join = ".".join
    inner = join(x for x in (level.outer, level.inner) if x)
    wanted = path_hash(join((inner, level.name)) if level.name else inner)
    nodes = np.flatnonzero((ix.path == wanted) & (ix.mark == _QUOTE) & (ix.end > ix.start))
    if level.where and len(nodes):
        key, text = level.where
        tags = np.flatnonzero((ix.path == path_hash(join((inner, key)))) & (ix.mark == _QUOTE))
        tags = tags[[x == text for x in _texts(ix, tags)]] if len(tags) else tags
        nodes = nodes[np.isin(ix.parent[nodes], ix.parent[tags])]
    if not len(nodes):
        return nodes, nodes, nodes, []
    low = _climb(ix, nodes, path_hash(inner))
    high = _climb(ix, low, path_hash(level.outer)) if level.outer else np.full(len(low), -1)
    outer = np.where(high >= 0, ix.position[np.maximum(high, 0)], 0)
    return ix.record[nodes], outer, ix.position[low], _texts(ix, nodes)


def indexed(values: pa.Array) -> Iterator[tuple[np.ndarray, Index]]:
    """(rows, index) for the texts of an Arrow column; wrapped texts follow as an index of their own."""
    rows = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    raws = values.cast(pa.binary()).take(pa.array(rows, pa.int64())).to_pylist()
    while len(rows):
        inner_rows, inner = [], []
        begin = total = 0
        for i in range(len(raws) + 1):
            if i < len(raws) and not (total and total + len(raws[i]) > _CHUNK):
                total += len(raws[i])
                continue
            part = raws[begin:i]
            ix = index(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
            yield rows[begin:i], ix
            wrapped = np.flatnonzero((ix.parent < 0) & (ix.mark == _QUOTE))
            inner_rows += rows[begin:i][ix.record[wrapped]].tolist()
            inner += [x.encode("utf-8", "surrogatepass") for x in _texts(ix, wrapped)]
            begin, total = i, len(raws[i]) if i < len(raws) else 0
        rows, raws = np.array(inner_rows, np.int64), inner


def linked_rows(records: DataFrame, record_id: str, payload: str, levels: list[Level]) -> DataFrame:
    """(record_id, outer_pos, inner_pos, name): one row for each text the levels name, linked to record and outer entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, ix in indexed(batch.column(1)):
                for level in levels:
                    record, outer, inner, names = linked(ix, level)
                    if len(names):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[record]], pa.int64()), pa.array(outer, pa.int32()), pa.array(inner, pa.int32()), pa.array(names, pa.string())], names=["record_id", "outer_pos", "inner_pos", "name"])

    slim = records.select(F.col(record_id).cast("long").alias("id"), F.col(payload).alias("payload")).filter("id IS NOT NULL AND payload IS NOT NULL")
    return slim.mapInArrow(run, "record_id long, outer_pos int, inner_pos int, name string")


def nodes(records: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(record_id, node, parent, position, path, kind, value): every value of every readable record as a flat row.

    ``node`` numbers the values of a record in order of appearance, ``parent`` is the node of
    the enclosing bracket (NULL at the root), ``path`` a hash equal for equal paths, ``kind``
    object, list, string or plain, ``value`` the text of a string or plain value.
    """
    kinds = {_OPEN[0]: "object", _OPEN[1]: "list", _QUOTE: "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, ix in indexed(batch.column(1)):
                wrapped = np.zeros(len(rows), bool)
                wrapped[ix.record[(ix.parent < 0) & (ix.mark == _QUOTE)]] = True
                kept = np.flatnonzero(~wrapped[ix.record])
                if not len(kept):
                    continue
                begin = np.searchsorted(ix.record, np.arange(len(rows)))
                base = begin[ix.record[kept]]
                kind = [kinds.get(m, "plain") for m in ix.mark[kept].tolist()]
                raw = ix.data.tobytes()
                value = [None if k in ("object", "list") else json.loads(b'"' + raw[a:b] + b'"') if k == "string" else raw[a:b].decode() for k, a, b in zip(kind, ix.start[kept].tolist(), ix.end[kept].tolist())]
                parent = ix.parent[kept]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[rows[ix.record[kept]]], pa.int64()), pa.array(kept - base, pa.int32()), pa.array(np.where(parent >= 0, parent - base, 0), pa.int32(), mask=parent < 0),
                    pa.array(ix.position[kept], pa.int32()), pa.array(ix.path[kept].view(np.int64), pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string()),
                ], names=["record_id", "node", "parent", "position", "path", "kind", "value"])

    slim = records.select(F.col(record_id).cast("long").alias("id"), F.col(payload).alias("payload")).filter("id IS NOT NULL AND payload IS NOT NULL")
    return slim.mapInArrow(run, "record_id long, node int, parent int, position int, path long, kind string, value string")


# Where the payloads of each kind of source name organisations and authors.
PAPER_ORGANISATIONS = [
    Level("authorships", "institutions", "display_name"),
    Level("author", "affiliation", "name"),
    Level("authors", "affiliations"),
    Level("MedlineCitation.Article.AuthorList", "AffiliationInfo", "Affiliation"),
    Level("bibjson.author", "affiliation"),
]
AUTHOR_ORGANISATIONS = [
    Level(None, "affiliations", "institution.display_name"),
    Level(None, "affiliations"),
    Level(None, "affiliation-current", "affiliation-name"),
    Level(None, "notes.note", "text", ("@type", "affiliation")),
]
PAPER_AUTHORS = [
    Level(None, "authorships", "author.display_name"),
    Level(None, "author", "family"),
    Level(None, "authors", "name"),
    Level(None, "MedlineCitation.Article.AuthorList", "LastName"),
    Level(None, "bibjson.author", "name"),
    Level(None, "info.authors.author", "text"),
]


def organisations(papers: DataFrame, authors: DataFrame) -> DataFrame:
    """(owner, owner_id, author_pos, org_pos, org_name) of each organisation named under an author."""
    out = []
    for owner, table, key, levels in (("paper", papers, "paper_id", PAPER_ORGANISATIONS), ("author", authors, "author_id", AUTHOR_ORGANISATIONS)):
        rows = linked_rows(table, key, "raw_data", levels)
        out.append(rows.select(F.lit(owner).alias("owner"), F.col("record_id").alias("owner_id"), F.col("outer_pos").alias("author_pos"), F.col("inner_pos").alias("org_pos"), F.col("name").alias("org_name")))
    return out[0].unionByName(out[1])


def paper_authors(papers: DataFrame) -> DataFrame:
    """(paper_id, author_pos, name): the authors named in the payloads, linked to the rows of ``organisations`` by their position."""
    rows = linked_rows(papers, "paper_id", "raw_data", PAPER_AUTHORS)
    return rows.select(F.col("record_id").alias("paper_id"), F.col("inner_pos").alias("author_pos"), "name")
