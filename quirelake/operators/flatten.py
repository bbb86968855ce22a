"""Deeply nested payloads to linked flat tables by vectorised structural indexing.

A batch of JSON texts is laid end to end in one byte buffer. Bitmaps mark backslashes, quotes and structural bytes; the
running parity of the quotes tells what lies inside strings, the running sum of the brackets gives the nesting depth,
and the opener that encloses each token is found by a sorted search within its depth. Pages, blocks, fields, cells and
metadata are then spans selected by (enclosing opener, key) or (enclosing opener, position); no record is parsed into
Python objects.

Defined cases: a null text, an empty text and any text that is not exactly one valid JSON value (cut off, trailing
bytes, bad escape, bad number, control character in a string) give no rows. Null pages, null blocks and null rows give
no rows but keep their positions. A field or cell whose value is null is a row. Cell names come from the cell's own key
(an object, or a list of {k, v}) or, for rows that are plain lists, from the column list; a plain cell beyond the column
list is named column_<i>. When an object repeats a key the last value holds. Nesting deeper than max_depth is invalid.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirelake.session import spread

OBJ, ENDOBJ, ARR, ENDARR, COLON, COMMA, STR, SCALAR = range(8)
_CODE = np.full(256, -1, np.int8)
for _i, _c in enumerate(b"{}[]:,"):
    _CODE[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
MAX_DEPTH = 64


class Index:
    """Token arrays over a batch of JSON texts: kind, start, end, record, level, parent, key, position, valid records."""

    def __init__(self, texts: list[bytes | None], max_depth: int = MAX_DEPTH):
        parts = [b"" if t is None else t for t in texts]
        n = len(parts)
        size = np.fromiter((len(p) + 1 for p in parts), np.int64, n)
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        self.buf = buf = b"\n".join(parts) + b"\n"
        a = self.bytes = np.frombuffer(buf, np.uint8)
        at = np.arange(len(a))
        # Quote bitmap: a quote counts unless an odd run of backslashes stands before it.
        slash = a == 92
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.zeros(len(a), np.int64)
        run[1:] = (at - last_other)[:-1]
        odd = (run & 1) == 1
        quote = (a == 34) & ~odd
        parity = np.zeros(len(a) + 1, np.int64)
        np.cumsum(quote, out=parity[1:])
        record_of = np.repeat(np.arange(n), size)
        inside = ((parity[1:] - parity[begin[:-1]][record_of]) & 1).astype(bool)  # the opening quote is inside, the closing one is not
        bad = np.zeros(n, bool)
        bad |= ((parity[begin[1:]] - parity[begin[:-1]]) & 1).astype(bool)
        bad[record_of[inside & (a < 32)]] = True
        esc = odd & inside
        bad[record_of[esc & ~_ESCAPED[a]]] = True
        u = np.flatnonzero(esc & (a == 117))
        if len(u):
            ok = np.ones(len(u), bool)
            for k in range(1, 5):
                ok &= _HEX[a[np.minimum(u + k, len(a) - 1)]]
            bad[record_of[u[~ok]]] = True
        bad[record_of[slash & ~inside]] = True
        # Tokens: structural bytes, opening quotes, starts of scalars.
        code = _CODE[a]
        outside = ~inside & ~quote
        structural = outside & (code >= 0)
        scalar = outside & (code < 0) & ~_SPACE[a]
        open_quote = quote & inside
        start_scalar = scalar.copy()
        start_scalar[1:] &= ~scalar[:-1]
        end_scalar = scalar.copy()
        end_scalar[:-1] &= ~scalar[1:]
        start = np.flatnonzero(structural | open_quote | start_scalar)
        kind = code[start].copy()
        kind[open_quote[start]] = STR
        kind[start_scalar[start]] = SCALAR
        end = start + 1
        rec = record_of[start]
        closing = np.flatnonzero(quote & ~inside)
        s = kind == STR
        if s.any():
            close_at = np.searchsorted(closing, start[s])
            end[s] = closing[np.minimum(close_at, max(len(closing) - 1, 0))] + 1 if len(closing) else start[s] + 1
        end[kind == SCALAR] = np.flatnonzero(end_scalar) + 1
        # Depth by prefix sums, per record.
        step = np.where((kind == OBJ) | (kind == ARR), 1, np.where((kind == ENDOBJ) | (kind == ENDARR), -1, 0))
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(step, out=total[1:])
        first = np.searchsorted(start, begin[:-1])
        after_last = np.searchsorted(start, begin[1:])
        base = total[first][rec] if len(rec) else rec
        level = np.where(step < 0, total[1:], total[:-1]) - base
        bad |= (total[after_last] - total[first]) != 0
        bad |= after_last == first
        if len(rec):
            bad[rec[(level < 0) | (level > max_depth)]] = True
        live = ~bad[rec] if len(rec) else np.zeros(0, bool)
        parent = np.full(len(start), -1, np.int64)
        opener = (kind == OBJ) | (kind == ARR)
        closer = (kind == ENDOBJ) | (kind == ENDARR)
        for depth in range(int(level[live].max()) + 1 if live.any() else 0):
            here = np.flatnonzero(opener & live & (level == depth))
            if not len(here):
                break
            for group, into in ((np.flatnonzero(live & ~closer & (level == depth + 1)), parent), (np.flatnonzero(live & closer & (level == depth)), parent)):
                found = np.searchsorted(here, group) - 1
                good = found >= 0
                into[group[good]] = here[found[good]]
                bad[rec[group[~good]]] = True
        # A closer must match its opener and lie in the same record; then the closer's parent becomes the opener's.
        c = np.flatnonzero(closer & (parent >= 0))
        bad[rec[c[(kind[parent[c]] + 1 != kind[c]) | (rec[parent[c]] != rec[c])]]] = True
        span_end = end.copy()
        span_end[parent[c]] = end[c]
        grand = parent[c]
        parent[c] = parent[grand]
        p = np.flatnonzero((parent >= 0) & (rec[np.maximum(parent, 0)] != rec))
        bad[rec[p]] = True
        in_obj = (parent >= 0) & (kind[np.maximum(parent, 0)] == OBJ)
        prev = np.full(len(start), -1, np.int64)  # kind of the token before, in the same record
        if len(start):
            prev[1:] = np.where(rec[1:] == rec[:-1], kind[:-1], -1)
        is_key = (kind == STR) & in_obj & ((prev == OBJ) | (prev == COMMA))
        value_start = (kind == OBJ) | (kind == ARR) | (kind == SCALAR) | ((kind == STR) & ~is_key)
        prev_key = np.zeros(len(start), bool)
        prev_key[1:] = is_key[:-1] & (rec[1:] == rec[:-1])
        prev_end = ((prev == ENDOBJ) | (prev == ENDARR) | (prev == SCALAR) | (prev == STR)) & ~prev_key
        ok = np.where(
            prev == -1, value_start,
            np.where(prev == OBJ, (kind == ENDOBJ) | is_key,
            np.where(prev == ARR, (kind == ENDARR) | value_start,
            np.where(prev == COLON, value_start,
            np.where(prev == COMMA, np.where(in_obj, is_key, value_start & (parent >= 0)),
            np.where(prev_key, kind == COLON, prev_end & (((kind == COMMA) & (parent >= 0)) | closer))))))
        )
        bad[rec[~ok]] = True
        top = np.bincount(rec[value_start & (level == 0)], minlength=n) if len(rec) else np.zeros(n, int)
        bad |= top != 1
        for i in np.flatnonzero((kind == SCALAR) & ~bad[rec]) if len(rec) else ():
            if not _NUMBER.fullmatch(buf, start[i], end[i]):
                bad[rec[i]] = True
        self.kind, self.start, self.end, self.rec, self.parent = kind, start, span_end, rec, parent
        self.valid = ~bad
        keep = value_start & ~bad[rec] if len(rec) else np.zeros(0, bool)
        self.values = np.flatnonzero(keep)
        self.key = np.where(in_obj, np.arange(len(start)) - 2, -1)
        # Position within a list: commas of the same list that stand before.
        order = np.lexsort((np.arange(len(start)), parent))
        commas = np.cumsum(kind[order] == COMMA)
        head = np.ones(len(order), bool)
        head[1:] = parent[order][1:] != parent[order][:-1]
        group = np.cumsum(head) - 1
        at_head = (commas - (kind[order] == COMMA))[head]
        self.position = np.empty(len(start), np.int64)
        self.position[order] = commas - at_head[group] if len(order) else commas
        self.null = (kind == SCALAR) & (a[start] == 110)

    def members(self, containers: np.ndarray) -> np.ndarray:
        """Values whose enclosing opener is one of the given tokens."""
        mark = np.zeros(len(self.kind) + 1, bool)
        mark[containers] = True
        return self.values[mark[self.parent[self.values]] & (self.parent[self.values] >= 0)]

    def child(self, objects: np.ndarray, name: str) -> np.ndarray:
        """For each object token the value under the key, or -1; the last one where the key is repeated."""
        objects = objects[self.kind[objects] == OBJ]
        v = self.members(objects)
        quoted = json.dumps(name).encode()
        k = self.key[v]
        hit = (self.end[k] - self.start[k]) == len(quoted)
        v, k = v[hit], k[hit]
        for j, byte in enumerate(quoted):
            same = self.bytes[self.start[k] + j] == byte
            v, k = v[same], k[same]
        out = np.full(len(self.kind), -1, np.int64)
        out[self.parent[v]] = v
        return out

    def text(self, token: int) -> str | None:
        """A scalar's text or a string's content; the JSON of an object or list."""
        if token < 0 or self.null[token]:
            return None
        raw = self.buf[self.start[token] : self.end[token]]
        if self.kind[token] != STR:
            return raw.decode("utf-8", "replace")
        body = raw[1:-1]
        if b"\\" not in body:
            return body.decode("utf-8", "replace")
        return json.loads(raw.decode("utf-8", "replace")).encode("utf-8", "replace").decode()

    def texts(self, tokens: np.ndarray) -> list[str | None]:
        return [self.text(int(t)) for t in tokens]


NODES = "rec int, kind string, page_pos int, block_pos int, row_pos int, item_key string, value string, confidence double, attrs map<string,string>"
PAGE_ATTRS = ("page_number", "page_type")
BLOCK_ATTRS = ("block_id", "type", "text", "source", "confidence", "bbox", "needs_review", "title")
KINDS = ("page", "block", "field", "cell", "meta")


def walk(ix: Index, kinds: tuple[str, ...] = KINDS, values: bool = True) -> dict[str, list]:
    """Rows of the wanted kinds from an index, as columns."""
    out: dict[str, list] = {k: [] for k in ("rec", "kind", "page_pos", "block_pos", "row_pos", "item_key", "value", "confidence", "attrs")}

    def emit(kind, tok, page_pos, block_pos, row_pos, keys, vals=None, conf=None, attrs=None):
        n = len(tok)
        out["rec"].append(ix.rec[tok].astype(np.int32))
        out["kind"] += [kind] * n
        for name, pos in (("page_pos", page_pos), ("block_pos", block_pos), ("row_pos", row_pos)):
            out[name].append(np.broadcast_to(np.asarray(pos, np.int32), (n,)))
        out["item_key"] += keys if isinstance(keys, list) else [keys] * n
        out["value"] += vals if vals is not None else [None] * n
        out["confidence"] += conf if conf is not None else [None] * n
        out["attrs"] += attrs if attrs is not None else [None] * n

    def attrs_of(tok, names):
        if not values:
            return None
        cols = [ix.texts(ix.child(tok, name)[tok]) for name in names]
        return [[(k, v) for k, v in zip(names, row) if v is not None] for row in zip(*cols)] if len(tok) else []

    nowhere = np.full(len(ix.kind) + 1, -1, np.int64)
    root = ix.values[(ix.parent[ix.values] < 0) & (ix.kind[ix.values] == OBJ)]
    lists = ix.child(root, "pages")[root]
    lists = lists[(lists >= 0)]
    lists = lists[ix.kind[lists] == ARR]
    pages = ix.members(lists)
    pages = pages[~ix.null[pages]]
    page_pos = nowhere.copy()
    page_pos[pages] = ix.position[pages]
    if "page" in kinds:
        emit("page", pages, page_pos[pages], -1, -1, "", attrs=attrs_of(pages, PAGE_ATTRS))
    lists = ix.child(pages, "blocks")
    owner = nowhere.copy()  # of a list or object: the page or block it belongs to
    has = np.flatnonzero(lists >= 0)
    owner[lists[has]] = has
    lists = lists[has]
    blocks = ix.members(lists[ix.kind[lists] == ARR])
    blocks = blocks[~ix.null[blocks]]
    block_pos = nowhere.copy()
    block_pos[blocks] = ix.position[blocks]
    page_pos[blocks] = page_pos[owner[ix.parent[blocks]]]
    if "block" in kinds:
        emit("block", blocks, page_pos[blocks], block_pos[blocks], -1, "", attrs=attrs_of(blocks, BLOCK_ATTRS))

    def under(name):
        """The objects under a key of the blocks, with their block."""
        c = ix.child(blocks, name)
        b = np.flatnonzero(c >= 0)
        owner[c[b]] = b
        return c[b]

    def last_of_key(tok):
        """Drops all but the last of the values that one object has under one key."""
        if len(tok) < 2:
            return tok, ix.texts(ix.key[tok])
        names = ix.texts(ix.key[tok])
        seen = {(p, k): i for i, (p, k) in enumerate(zip(ix.parent[tok].tolist(), names))}
        keep = sorted(seen.values())
        return tok[keep], [names[i] for i in keep]

    for kind, name in (("field", "fields"), ("meta", "metadata")):
        if kind not in kinds:
            continue
        objects = under(name)
        tok, names = last_of_key(ix.members(objects[ix.kind[objects] == OBJ]))
        b = owner[ix.parent[tok]] if len(tok) else tok
        vals = conf = None
        if values:
            inner, sure = ix.child(tok, "value"), ix.child(tok, "confidence")
            pick = np.where(ix.kind[tok] == OBJ, inner[tok], tok)
            vals = ix.texts(pick)
            conf = [None if x is None else float(x) for x in ix.texts(sure[tok])] if kind == "field" else None
        emit(kind, tok, page_pos[b], block_pos[b], -1, names, vals, conf)
    if "cell" in kinds:
        data = under("structured_data")
        data = data[ix.kind[data] == OBJ]
        rows, columns = ix.child(data, "rows"), ix.child(data, "columns")
        has = np.flatnonzero(rows >= 0)
        owner[rows[has]] = has
        rows = rows[has]
        row = ix.members(rows[ix.kind[rows] == ARR])
        row = row[~ix.null[row]]
        block_of = nowhere.copy()
        if len(row):
            block_of[row] = owner[owner[ix.parent[row]]]
        # rows that are objects
        tok, names = last_of_key(ix.members(row[ix.kind[row] == OBJ]))
        # rows that are lists: {k, v} objects, or plain values named by the columns
        item = ix.members(row[ix.kind[row] == ARR])
        pair_key = ix.child(item, "k")[item] if len(item) else item
        as_pair = pair_key >= 0
        plain = item[~as_pair & (ix.kind[item] != OBJ)]
        col_names: dict[int, list] = {}
        plain_names = []
        for t in plain.tolist():
            d = int(owner[ix.parent[ix.parent[t]]])
            if d not in col_names:
                c = int(columns[d])
                col_names[d] = ix.texts(ix.members(np.array([c]))) if c >= 0 and ix.kind[c] == ARR else []
            i = int(ix.position[t])
            named = col_names[d][i] if i < len(col_names[d]) else None
            plain_names.append(named if named is not None else f"column_{i}")
        pairs, pair_key = item[as_pair], pair_key[as_pair]
        pair_names = ix.texts(pair_key)
        named = [i for i, x in enumerate(pair_names) if x is not None]
        pairs, pair_names = pairs[named], [pair_names[i] for i in named]
        for cells, keys, inner in ((tok, names, "value"), (plain, plain_names, "value"), (pairs, pair_names, "v")):
            if not len(cells):
                continue
            r = ix.parent[cells]
            b = block_of[r]
            vals = ix.texts(np.where(ix.kind[cells] == OBJ, ix.child(cells, inner)[cells], cells)) if values else None
            emit("cell", cells, page_pos[b], block_pos[b], ix.position[r], keys, vals)
    for name in ("rec", "page_pos", "block_pos", "row_pos"):
        out[name] = np.concatenate(out[name]) if out[name] else np.zeros(0, np.int32)
    return out


_ARROW = {
    "kind": pa.string(), "page_pos": pa.int32(), "block_pos": pa.int32(), "row_pos": pa.int32(), "item_key": pa.string(),
    "value": pa.string(), "confidence": pa.float64(), "attrs": pa.map_(pa.string(), pa.string()),
}


def flatten_json(df: DataFrame, id_col: str, json_col: str, kinds: tuple[str, ...] = KINDS, values: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes of every payload: (id, kind, page_pos, block_pos, row_pos, item_key, value, confidence, attrs).

    The id and the positions name every parent: a block's page is (id, page_pos), a field's or cell's block (id, page_pos,
    block_pos). values=False leaves value, confidence and attrs null and saves their decoding.
    """
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[dict(df.dtypes)[id_col]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                ix = Index([None if t is None else t.encode() for t in texts[lo : lo + 256]], max_depth)
                rows = walk(ix, kinds, values)
                if not len(rows["rec"]):
                    continue
                own = ids.slice(lo, 256).take(pa.array(rows["rec"]))
                yield pa.RecordBatch.from_arrays([own.cast(id_type), *(pa.array(rows[k], t) for k, t in _ARROW.items())], [id_col, *_ARROW])

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, kind string, page_pos int, block_pos int, row_pos int, item_key string, value string, confidence double, attrs map<string,string>"
    return df.select(id_col, json_col).mapInArrow(run, schema)


def payload_json(payloads: DataFrame) -> DataFrame:
    """record_id and the pages of typed payloads as JSON text, nulls written out; one row per record_id."""
    text = F.to_json(F.struct("pages"), {"ignoreNullFields": "false"})
    return spread(payloads.select("record_id", text.alias("payload")), "record_id").groupBy("record_id").agg(F.max("payload").alias("payload"))


def raw_json(raw: DataFrame) -> DataFrame:
    """record_id and payload text; one row per record_id."""
    return spread(raw.select("record_id", "payload"), "record_id").groupBy("record_id").agg(F.max("payload").alias("payload"))


def all_nodes(payloads: DataFrame, raw: DataFrame, kinds: tuple[str, ...] = KINDS, values: bool = True) -> DataFrame:
    return flatten_json(payload_json(payloads).unionByName(raw_json(raw)), "record_id", "payload", kinds, values)


def pages_table(nodes: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return nodes.where("kind = 'page'").select("record_id", "page_pos", F.expr("try_cast(attrs['page_number'] AS int)").alias("page_number"), a["page_type"].alias("page_type"))


def blocks_table(nodes: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return nodes.where("kind = 'block'").select(
        "record_id", "page_pos", "block_pos", a["block_id"].alias("block_id"), a["type"].alias("type"), a["text"].alias("text"), a["source"].alias("source"),
        F.expr("try_cast(attrs['confidence'] AS double)").alias("confidence"), F.from_json(a["bbox"], "array<double>").alias("bbox"),
        F.expr("try_cast(attrs['needs_review'] AS boolean)").alias("needs_review"), a["title"].alias("title"),
    )


def fields_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'field'").select("record_id", "page_pos", "block_pos", F.col("item_key").alias("name"), "value", "confidence")


def cells_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'cell'").select("record_id", "page_pos", "block_pos", "row_pos", F.col("item_key").alias("column_name"), "value")


def metadata_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'meta'").select("record_id", "page_pos", "block_pos", F.col("item_key").alias("name"), "value")
