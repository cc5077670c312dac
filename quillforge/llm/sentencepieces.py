"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into *units*, at spaces and wherever no piece of the model can span two neighbouring bytes, so units are encoded each by
itself. The distinct units of all texts form a table. Their substrings of bounded length are exploded and equi-joined to the
piece table; the matches, the edges of each unit's lattice, are grouped by unit and folded by Spark's ``aggregate``:

* unigram models: Viterbi over the unit's positions, the best score at each and the piece that reaches it;
* merge models (BPE): their encoding is no best sum of scores. The same edges are folded in the order of their rank; an edge
  replaces the symbols between its ends if there are just two. As a piece's two parts always rank before it (checked when the model is read), one
  pass is exact.

Units beyond ``FOLD_CHARS`` and units with characters that no piece has (they fall back to bytes) are encoded by an exact scan
in Arrow batches instead. Texts are then coded by lookups: units are identified by 64 bits of hash; the most frequent, up to ``DICTIONARY_BYTES``, are sent to the executors, the
others are exploded and joined to the unit table.

Defined results: a NULL text has NULL pieces and decodes to NULL, an empty one has none; U+2581 counts as a space, so it decodes to one;
otherwise decoding gives the text back, whatever its length; rows without an id, repeated rows and other columns are kept as they are,
except columns of the names that are made, which are replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .bpe import Merges
from .common import arrow_map, give_back, list_array, map_batches, materialize, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FOLD_CHARS = 61
DICTIONARY_BYTES = 128 << 20
#: Bytes of texts, whole ones, that are worked on at once.
TEXT_BYTES = 1 << 19
META = "▁"


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class PieceModel:
    """pieces: all by id; usable: ids of ordinary pieces by rank; unigram: Viterbi, else merges; byte_base: id of byte 0's piece or None."""

    pieces: list[str]
    scores: list[float]
    usable: list[int]
    unigram: bool
    byte_base: int | None
    unknown: int
    dummy_prefix: bool

    @functools.cached_property
    def longest(self) -> int:
        return max((len(self.pieces[i]) for i in self.usable), default=1)

    @functools.cached_property
    def merges(self) -> Merges:
        return Merges([self.pieces[i] for i in self.usable])

    @functools.cached_property
    def spans(self) -> np.ndarray:
        """Pairs of bytes (256 x 256) that are neighbours within some piece, spaces for U+2581."""
        out = np.zeros((256, 256), bool)
        for i in self.usable:
            b = np.frombuffer(self.pieces[i].replace(META, " ").encode(), np.uint8)
            out[b[:-1], b[1:]] = True
        return out

    def byte_ids(self, text: str) -> list[int]:
        return [self.byte_base + b for b in text.encode()] if self.byte_base is not None else [self.unknown]

    def encode_unit(self, unit: str) -> list[int]:
        """Piece ids of a unit (spaces as U+2581), by an exact scan; the yardstick of the fold."""
        out: list[int] = []
        if not self.unigram:
            at = 0
            for t in self.merges.encode(unit):
                size = len(self.merges.tokens[t]) if t >= 0 else 1
                out += [self.usable[t]] if t >= 0 else self.byte_ids(unit[at : at + 1])
                at += size
            return out
        index = {self.pieces[i]: i for i in self.usable}
        worst = min((self.scores[i] for i in self.usable), default=0.0) - 10.0
        best, back = [0.0] + [-np.inf] * len(unit), [(0, -1)] * (len(unit) + 1)
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - self.longest), e):
                i = index.get(unit[s:e], -1 if e - s == 1 else None)
                if i is not None and (got := best[s] + (self.scores[i] if i >= 0 else worst)) > best[e]:
                    best[e], back[e] = got, (s, i)
        path, e = [], len(unit)
        while e:
            s, i = back[e]
            path.append([i] if i >= 0 else self.byte_ids(unit[s:e]))
            e = s
        return [i for part in path[::-1] for i in part]


def read_model(path: str = MODEL) -> PieceModel:
    """A SentencePiece model file with the identity normaliser that keeps extra spaces (others raise)."""
    import struct

    pieces, scores, kinds, trainer, norm = [], [], [], {}, {}
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f.get(1, b"").decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if norm.get(2) or norm.get(4, 1):
        raise ValueError("only the identity normaliser without removal of extra spaces is supported")
    usable = sorted((i for i, k in enumerate(kinds) if k in (1, 4)), key=lambda i: (-scores[i], i))
    unigram = trainer.get(3, 1) == 1
    bytes_at = next((i for i, k in enumerate(kinds) if k == 6), None)
    model = PieceModel(pieces, scores, usable, unigram, bytes_at, kinds.index(2) if 2 in kinds else 0, bool(norm.get(3, 1)))
    if not unigram and model.merges.dead:
        raise ValueError("the model has pieces that no merge makes")
    return model


def units_of(model: PieceModel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with U+2581 as space and the dummy prefix, unit starts, unit ends, first unit of each text)."""
    if len(data) > 2:
        meta = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(meta):
            keep = np.ones(len(data), bool)
            keep[meta + 1] = keep[meta + 2] = False
            data = data.copy()
            data[meta] = 32
            offs = np.concatenate([[0], np.cumsum(keep)])[offs]
            data = data[keep]
    if model.dummy_prefix:
        some = offs[1:] > offs[:-1]
        data = np.insert(data, offs[:-1][some], np.uint8(32))
        offs = offs + np.concatenate([[0], np.cumsum(some)])
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cut = np.ones(n, bool)
    for lo in range(1, n, 1 << 17):  # the pairs' numbers take eight times the bytes
        a, b = data[lo - 1 : min(n, lo + (1 << 17)) - 1], data[lo : lo + (1 << 17)]
        cut[lo : lo + (1 << 17)] = ~model.spans[a, b] & ((b & 0xC0) != 0x80)
    cut[offs[:-1][offs[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], n), np.searchsorted(start, offs)


def unit_table(texts: DataFrame, model: PieceModel) -> DataFrame:
    """(h, unit, n): every distinct unit of the column text, with its number of places."""

    def run(batch: pa.RecordBatch):
        for _, _, raw, raw_offs in tk.slices(batch.column("text"), TEXT_BYTES):  # what slices share is summed before the shuffle
            data, start, end, _ = units_of(model, raw, raw_offs)
            if not len(start):
                continue
            h, first, n = np.unique(tk.span_hashes(data, start, end), return_index=True, return_counts=True)
            size = end[first] - start[first]
            at = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(at[-1]) - np.repeat(at[:-1] - start[first], size)
            yield {"h": h.view(np.int64), "unit": pa.StringArray.from_buffers(len(h), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[take])), "n": n}

    return arrow_map(texts.select("text"), run, "h bigint, unit string, n bigint").groupBy("h", "unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, model: PieceModel) -> DataFrame:
    """(h, unit, n, size, singles, edges): the pieces that each unit holds. For unigram models an edge is (s, e, id, score); for merges it is one number, rank, place, end and id from the
    high bits down, so sorted edges are in the order of rank. Units that the fold leaves have fewer single characters than their size. The table of units is grouped by h already, so nothing is shuffled."""
    rank = {i: k for k, i in enumerate(model.usable)}
    table = pa.table({"piece": [model.pieces[i] for i in model.usable], "id": pa.array(model.usable, pa.int64()), "rank": pa.array([rank[i] for i in model.usable], pa.int64()), "score": [model.scores[i] for i in model.usable]})
    pieces = units.sparkSession.createDataFrame(table)
    own = units.withColumn("text", F.translate("unit", " ", META)).withColumn("size", F.length("unit"))
    fits = F.col("size") <= FOLD_CHARS
    sub = own.select("h", "unit", "n", "text", "size", F.explode(F.sequence(F.lit(0), F.when(fits, F.col("size") - 1).otherwise(0))).alias("s"))
    longest = F.when(fits, F.least(F.lit(model.longest), F.col("size") - F.col("s"))).otherwise(1)
    sub = sub.select("h", "unit", "n", "text", "size", "s", F.explode(F.sequence(F.lit(1), longest)).alias("k"))
    sub = sub.select("h", "unit", "n", "size", "s", (F.col("s") + F.col("k")).alias("e"), F.substring("text", F.col("s") + 1, F.col("k")).alias("piece"))
    # the piece table's size is the model's, whatever the texts
    edge = sub.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR e - s = 1")
    if model.unigram:
        cell = F.when(F.col("id").isNotNull(), F.struct("s", "e", F.col("id").cast("int").alias("id"), "score"))
    else:
        cell = F.shiftleft("rank", 36).bitwiseOR(F.shiftleft(F.col("s").cast("bigint"), 30)).bitwiseOR(F.shiftleft(F.col("e").cast("bigint"), 24)).bitwiseOR(F.col("id"))
    singles = F.count(F.when((F.col("e") - F.col("s") == 1) & F.col("id").isNotNull(), 1))
    return edge.groupBy("h", "unit", "n", "size").agg(F.sort_array(F.collect_list(cell)).alias("edges"), singles.alias("singles"))


def fold_merges(size, edges):
    """Ids of a unit's pieces: bits of ``state`` are the borders between symbols; an edge whose ends are borders with just one between takes that one away."""
    one = F.lit(1).cast("bigint")
    bit = lambda k: F.call_function("shiftleft", one, k.cast("int"))
    s = lambda x: F.shiftright(x, 30).bitwiseAND(63)
    e = lambda x: F.shiftright(x, 24).bitwiseAND(63)
    inner = lambda x: bit(e(x)) - bit(s(x) + 1)
    ends = lambda x: bit(s(x)).bitwiseOR(bit(e(x)))

    def step(state, x):
        between = state.bitwiseAND(inner(x))
        return F.when((F.bit_count(between) == 1) & (state.bitwiseAND(ends(x)) == ends(x)), state.bitwiseXOR(between)).otherwise(state)

    state = F.aggregate(F.filter(edges, lambda x: e(x) - s(x) > 1), F.call_function("shiftleft", one, size + 1) - 1, step)
    used = lambda st: F.filter(edges, lambda x: st.bitwiseAND(ends(x).bitwiseOR(inner(x))) == ends(x))
    return state, lambda st: F.transform(F.array_sort(F.transform(used(st), lambda x: x.bitwiseAND((1 << 36) - 1))), lambda x: x.bitwiseAND((1 << 24) - 1).cast("int"))


def fold_viterbi(size, edges):
    """Ids of the path of the highest total score; ties go to the edge that begins first. The state holds score, place and id of the best edge into each position."""
    cell = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("s"), F.lit(-1).alias("id"))

    def step(best, e):
        into = F.filter(edges, lambda x: x["e"] == e)
        worth = F.transform(into, lambda x: F.struct((F.get(best, x["s"])["v"] + x["score"]).alias("v"), (-x["s"]).alias("s"), x["id"].alias("id")))
        top = F.array_max(worth)
        return F.concat(best, F.array(F.struct(top["v"].alias("v"), (-top["s"]).alias("s"), top["id"].alias("id"))))

    best = F.aggregate(F.sequence(F.lit(1), size), F.array(cell), step)

    def path(b):
        start = F.struct(size.alias("at"), F.array().cast("array<int>").alias("ids"))
        walk = lambda a, _: F.when(a["at"] == 0, a).otherwise(F.struct(F.get(b, a["at"])["s"].alias("at"), F.concat(F.array(F.get(b, a["at"])["id"]), a["ids"]).alias("ids")))
        return F.aggregate(F.sequence(F.lit(1), size), start, walk)["ids"]

    return best, path


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """(h, n, ids) of every unit."""
    edges = lattice(units, model)
    state, ids = (fold_viterbi if model.unigram else fold_merges)(F.col("size"), F.col("edges"))
    folds = F.col("singles") == F.col("size")
    # as an element of an array the state is made once a unit; as a column it would be put into the lambda and made again for each edge
    joined = edges.withColumn("ids", F.when(folds, F.transform(F.array(state), ids)[0]))

    def rest(batch: pa.RecordBatch):
        ids = batch.column("ids")
        todo = np.flatnonzero(np.asarray(ids.is_null()))
        if len(todo):
            words = batch.column("unit").take(pa.array(todo)).to_pylist()
            own = pa.array([model.encode_unit(w.replace(" ", META)) for w in words], ids.type)
            place = np.arange(batch.num_rows)
            place[todo] = batch.num_rows + np.arange(len(todo))
            ids = pa.concat_arrays([ids, own]).take(pa.array(place))
        yield {"h": batch.column("h"), "n": batch.column("n"), "ids": ids}

    return arrow_map(joined.select("h", "unit", "n", "ids"), rest, "h bigint, n bigint, ids array<int>")


@dataclass
class Dictionary:
    """keys: sorted unit hashes; ids[first[i]:first[i + 1]] are the pieces of unit i."""

    keys: np.ndarray
    first: np.ndarray
    ids: np.ndarray


def split_dictionary(coded: DataFrame, limit: int = DICTIONARY_BYTES) -> tuple[Dictionary, DataFrame | None]:
    """The most frequent units, within ``limit`` bytes, for the executors, and the others' table if there are others. They come packed, one partition at a time, so
    the driver holds little besides the dictionary itself."""
    sums = coded.groupBy("n").agg(F.count("*").alias("c"), F.sum(F.size("ids")).alias("s"), F.max(F.array_max("ids")).alias("top"))
    by = sorted((r["n"], r["c"], r["s"], r["top"] or 0) for r in sums.toArrow().to_pylist())[::-1]
    total, least, units, size, top = 0, None, 0, 0, 0
    for n, c, s, t in by:
        total += 12 * c + 4 * s
        if total > limit:
            break
        least, units, size, top = n, units + c, size + s, max(top, t)
    every = bool(by) and least == by[-1][0]
    small = np.uint16 if top < 1 << 16 else np.int32
    h, first, ids = np.empty(units, np.uint64), np.zeros(units + 1, np.int32), np.empty(size, small)
    at = begin = 0
    if least is not None:
        for r in _packed(coded if every else coded.where(F.col("n") >= least), small).toLocalIterator():
            own, sizes, pieces = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["ids"], small)
            h[at : at + len(own)], first[at + 1 : at + 1 + len(own)], ids[begin : begin + len(pieces)] = own, sizes, pieces
            at, begin = at + len(own), begin + len(pieces)
    sizes = first[1:].copy()
    np.cumsum(sizes, out=first[1:])
    order = np.argsort(h).astype(np.int32)
    d = Dictionary(h[order], np.zeros(units + 1, np.int32), np.empty_like(ids))
    np.cumsum(sizes[order], out=d.first[1:])
    for lo in range(0, units, 1 << 17):  # the pieces' places take eight times the bytes
        some = order[lo : lo + (1 << 17)]
        n = sizes[some].astype(np.int64)
        take = np.arange(n.sum()) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        d.ids[d.first[lo] : d.first[lo + len(some)]] = ids[take]
    return d, None if every or not by else (coded if least is None else coded.where(F.col("n") < least)).select("h", "ids")


def _packed(coded: DataFrame, kind: type) -> DataFrame:
    """(h, sizes, ids): the hashes, numbers of pieces and pieces of many units as the bytes of arrays."""

    def run(batch: pa.RecordBatch):
        ids = batch.column("ids")
        sizes, pieces = np.asarray(pc.list_value_length(ids), dtype=np.int32), np.asarray(ids.flatten()).astype(kind)
        yield {"h": pa.array([np.asarray(batch.column("h"), dtype=np.int64).tobytes()]), "sizes": pa.array([sizes.tobytes()]), "ids": pa.array([pieces.tobytes()])}

    return arrow_map(coded.select("h", "ids"), run, "h binary, sizes binary, ids binary")


def code_slice(model: PieceModel, d: Dictionary, raw: np.ndarray, raw_offs: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """The pieces of each text and, where units aren't in the dictionary, -1 - k for the k-th entry of the text's list of missing units."""
    data, start, end, first = units_of(model, raw, raw_offs)
    h = tk.span_hashes(data, start, end)
    if len(d.keys):
        at = np.minimum(np.searchsorted(d.keys, h), len(d.keys) - 1)
        known = d.keys[at] == h
        begin = d.first[at].astype(np.int64)
        some = d.first[at + 1] - begin
        some[~known] = 1
    else:
        known, begin, some = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.ones(len(h), np.int64)
    place = np.concatenate([[0], np.cumsum(some)])
    lost = np.flatnonzero(~known)
    begin[lost] = 0
    out = np.zeros(place[-1], np.int32)
    if len(d.ids):
        src = np.arange(place[-1]) + np.repeat(begin - place[:-1], some)
        out = d.ids[src].astype(np.int32)
    lost_first = np.searchsorted(lost, first)
    if len(lost):
        out[place[lost]] = -1 - (np.arange(len(lost)) - lost_first[np.searchsorted(first, lost, "right") - 1])
    return list_array(pa.array(out, pa.int32()), place[first].astype(np.int32)), list_array(pa.array(h[lost].view(np.int64)), lost_first.astype(np.int32))


def encode(docs: DataFrame, model: PieceModel, limit: int = DICTIONARY_BYTES, decoded: bool = False) -> DataFrame:
    """docs with ``piece_ids``, the pieces of text, and where asked for with ``decoded``, the text that these stand for."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    plain = docs.drop("piece_ids", *(["decoded"] if decoded else []))
    spark = docs.sparkSession
    texts = plain.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    coded = materialize(encode_units(unit_table(texts, model), model), "unit_pieces")
    d, others = split_dictionary(coded, limit)
    sent = spark.sparkContext.broadcast((d.keys, d.first, d.ids))
    del d
    give_back()
    text_at, partial = plain.columns.index("text"), others is not None
    row, lost, met = unused(plain, "row", "lost", "met")
    schema = StructType(plain.schema.fields[:]).add("piece_ids", ArrayType(IntegerType()))
    if partial:
        schema.add(lost, ArrayType(LongType()))
    at_once = decoded and not partial
    if at_once:
        schema.add("decoded", StringType())
    names, lookup = schema.names, piece_bytes(model)

    def run(batches):
        d = Dictionary(*sent.value)
        for batch in batches:
            own = batch.column(text_at).cast(pa.string())
            for lo, hi, data, offs in tk.slices(own, TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, missing = code_slice(model, d, data, offs)
                null = own.slice(lo, hi - lo).is_null()
                if null.true_count:
                    ids = pc.if_else(null, pa.scalar(None, ids.type), ids)
                cols = [*part.columns, ids]
                if partial:
                    cols.append(missing)
                if at_once:
                    cols.append(decode_lists(ids, lookup, model.dummy_prefix))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = map_batches(plain, run, schema)
    if not partial:
        return rows
    rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "coded")
    want = rows.where(F.size(lost) > 0).select(row, F.posexplode(lost).alias("k", "h"))
    found = want.join(others, "h").groupBy(row).agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias(met))
    filled = F.flatten(F.transform("piece_ids", lambda i: F.when(i < 0, F.get(met, -1 - i)["ids"]).otherwise(F.array(i))))
    joined = rows.join(found, row, "left")
    out = joined.withColumn("piece_ids", F.when(F.col(met).isNull(), F.col("piece_ids")).otherwise(filled)).select(*[F.col(f"`{c}`") for c in plain.columns], "piece_ids")
    return decode(out, model) if decoded else out


def piece_bytes(model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) that each piece decodes to; control pieces to none."""
    usable = set(model.usable)
    raw = []
    for i, p in enumerate(model.pieces):
        if model.byte_base is not None and model.byte_base <= i < model.byte_base + 256:
            raw.append(bytes([i - model.byte_base]))
        elif i in usable:
            raw.append(p.replace(META, " ").encode())
        else:
            raw.append(" ⁇ ".encode() if i == model.unknown else b"")
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def decode_lists(lists: pa.ListArray, lookup: tuple[np.ndarray, np.ndarray], dummy_prefix: bool) -> pa.Array:
    """The texts of lists of pieces."""
    data, first = lookup
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    ids = np.asarray(lists.flatten())
    n = first[ids + 1] - first[ids]
    place = np.concatenate([[0], np.cumsum(n)])
    out = data[np.arange(place[-1]) + np.repeat(first[ids] - place[:-1], n)]
    ends = place[np.concatenate([[0], np.cumsum(size)])]
    if dummy_prefix:
        lead = ends[:-1][(ends[1:] > ends[:-1])]
        lead = lead[out[lead] == 32]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        out = out[keep]
    text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
    if lists.null_count:
        text = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), text)
    return text.cast(pa.string())


def decode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """docs with ``decoded``: the text that piece_ids stand for."""
    from pyspark.sql.types import StringType, StructType

    plain = docs.drop("decoded")
    at, names = plain.columns.index("piece_ids"), [*plain.columns, "decoded"]
    lookup, dummy_prefix = piece_bytes(model), model.dummy_prefix

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # whole lists, some at a time
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_lists(part.column(at), lookup, dummy_prefix)], names=names)

    return map_batches(plain, run, StructType(plain.schema.fields[:]).add("decoded", StringType()))
