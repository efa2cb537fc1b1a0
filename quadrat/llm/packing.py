"""Sum-of-squares packing of tokenised documents into sequences of ``LENGTH`` tokens.

Pieces are dealt over groups of about ``GROUP`` by a hash of their row; each group is packed by itself, in a task of
bounded size. Within a group every piece is placed one by one, largest first: it goes to the open sequence where the sum
of the squared counts of open sequences per residual gap becomes smallest (ties to the least gap), and a new sequence is
opened only if none has room. Groups share no sequence, so a corpus takes at most about one sequence a group more than it
must, one in some 100,000. Nothing but the number of pieces reaches the driver, and nothing is broadcast.

Tokens: a document's ids and then ``END``. Where the tokenizer allows it, which is asked of the tokenizer itself (see
``Encoder``), each distinct word (run without ASCII white space) of a batch is encoded once, words of Latin-1 letters
without regard to case and apart from a full stop or comma behind them; a worker remembers KNOWN_WORDS of them, with a
batch's more at most. Other tokenizers get whole texts.

Defined results: null texts are empty, one END token; rows that repeat are packed each; ids may be null; an empty table
gives no rows; documents longer than LENGTH are cut into full pieces and a rest; other columns are passed over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import common as C

LENGTH, END, GROUP = 2048, 0, 262_144
CHUNK, KNOWN_WORDS = 8_000_000, 1_000_000
#: The letters of Latin-1. They have no decompositions among themselves and lower to one another, whatever stands next to them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,"
NEVER = np.int64(1) << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, as the tokenizer gives them for each whole text.

    What may be encoded apart is found by asking the tokenizer. ``by_words``: white space joins nothing and gives nothing.
    ``folds``: each Latin-1 letter is lowered by itself. ``splits``: a mark behind any such letter is cut from it before
    merging.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        letters = re.findall(f"[{LETTERS}]", "".join(map(chr, range(256))))
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda s: [(s, (0, len(s)))]
        self.by_words = all(ids(f"{s}a{s}.{s}a.{s}") == ids("a") + ids(".") + ids("a.") for s in (*C.SPACE, " \n "))
        self.folds = all(normal(f"a{x}a") == f"a{x.lower()}a" for x in letters)
        self.splits = all([p for p, _ in cut(normal(f"a{x}{m}"))][1:] == [m] for x in letters for m in MARKS)
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool) if suffix else None
        if suffix:
            self.closing[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()

    def learnt(self, words: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, the number of each word's). Many at a time; a token belongs to the word that it starts in.
        alone: each word is merged as a whole, so its tokens end with the first one that closes a word."""
        values, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            text = " ".join(part)
            if alone and self.closing is not None:
                values.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
                ends = np.flatnonzero(self.closing[values[-1]]) + 1
                if len(ends) == len(part):
                    sizes.append(np.diff(ends, prepend=0))
                    continue
                values.pop()
            found = self.tokenizer.encode(text, add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            values.append(np.array(found.ids, np.uint32))
            sizes.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        return np.concatenate(values), np.concatenate(sizes)

    def forget(self) -> None:
        """Starts the memory anew: known words, all their ids, and where each one's begin (and the last one's end)."""
        self.known = pa.array([*MARKS], pa.large_string())
        self.values, sizes = self.learnt([*MARKS], False)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])

    def places(self, words: pa.Array, alone: np.ndarray) -> np.ndarray:
        """Where each of these distinct words is in the memory, which learns the new ones."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        new = pc.is_null(pc.index_in(words, value_set=self.known)).to_numpy(zero_copy_only=False)
        for own in (True, False):
            some = words.filter(pa.array(new & (alone == own)))
            values, sizes = self.learnt(some.to_pylist(), own)
            self.known = pa.concat_arrays([self.known, some])
            self.values = np.concatenate([self.values, values])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
        return pc.index_in(words, value_set=self.known).to_numpy()

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.values.dictionary_encode()
        stems = words.dictionary
        mark = np.zeros(len(stems), np.int64)  # from 1; 0 for none
        plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+[{MARKS}]?$")
        if self.splits:
            for k, m in enumerate(MARKS):
                mark[pc.and_(plain, pc.ends_with(stems, m)).to_numpy(zero_copy_only=False)] = k + 1
            stems = pc.if_else(plain, pc.utf8_rtrim(stems, MARKS), stems)
        if self.folds:
            stems = pc.if_else(plain, pc.utf8_lower(stems), stems)
        stems = stems.dictionary_encode()
        alone = np.zeros(len(stems.dictionary), bool)
        alone[stems.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = self.splits
        at = self.places(stems.dictionary, alone)[stems.indices.to_numpy()]
        # Each distinct word: its stem's ids, and its mark's.
        own = np.stack([at, np.maximum(mark - 1, 0)], 1).ravel()
        many = np.diff(self.begins)[own]
        many[1::2][mark == 0] = 0
        values = self.values[_ranges(self.begins[own], many)]
        begins = np.concatenate([[0], np.cumsum(many)[1::2]]).astype(np.int64)
        # Each word of the texts.
        which = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(begins)[which])])[split.offsets.to_numpy()]
        listed = pa.LargeListArray.from_arrays(pa.array(begins), pa.array(values))
        flat = listed.take(pa.array(which)).flatten().to_numpy()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (number[0] of them), then those from first[1], and so on."""
    ends = np.cumsum(number)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - number), number)


_KNOWN: dict[str, Encoder] = {}  # by path; a worker process keeps it over tasks


def _parts(texts: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(text's place, text), in parts of at most about CHUNK characters that are cut at white space."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > CHUNK and (m := re.compile(f"[{C.SPACE}]").search(t, at + CHUNK)):
            yield i, t[at : m.start()]
            at = m.start()
        yield i, t[at:]


def _encoded(texts: list[str], encoder: Encoder) -> Iterator[np.ndarray]:
    """The texts' ids, in their order, worked off CHUNK characters at a time."""
    some, size, own, last = [], 0, [], 0
    parts = _parts(texts) if encoder.by_words else enumerate(texts)

    def done() -> Iterator[np.ndarray]:
        nonlocal own, last
        for (i, _), ids in zip(some, encoder.encoded([t for _, t in some])):
            if i > last:
                yield np.concatenate(own)
                own, last = [], i
            own.append(ids)

    for part in parts:
        some.append(part)
        size += len(part[1])
        if size >= CHUNK:
            yield from done()
            some, size = [], 0
    yield from done()
    if own:
        yield np.concatenate(own)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """_id, piece, start, length, ids_crc32 (and ids): a row for each piece of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _KNOWN:
            _KNOWN[tokenizer] = Encoder(tokenizer)
        end = np.full(1, END, "<u4")
        for b in batches:
            of, piece, start, size, code, ids = [], [], [], [], [], []
            texts = [t.as_py() or "" for t in b.column("text")]
            for i, own in enumerate(_encoded(texts, _KNOWN[tokenizer])):
                for k, at in enumerate(range(0, len(own) + 1, length)):
                    part = own[at : at + length].astype("<u4", copy=False)
                    if at + length > len(own):
                        part = np.concatenate([part, end])
                    of.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    code.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [b.column("_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, code))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)

    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def placed(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, for sizes in falling order: sequences are numbered from 0."""
    open_ = np.zeros(length + 1, np.int64)  # by gap
    held: list[list[int]] = [[] for _ in range(length + 1)]  # by gap: open sequences
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    new = 0
    for i, size in enumerate(sizes.tolist()):
        gaps = open_[size:length]
        if gaps.any():
            # A sequence of gap g becomes one of gap g - size: the sum of squares grows by 2 (n[g - size] - n[g]) + 2.
            growth = np.where(gaps > 0, 2 * (open_[: length - size] - gaps) + 2, NEVER)
            if gaps[0]:
                growth[0] = 1 - 2 * gaps[0]  # a full sequence is open no more
            gap = size + int(growth.argmin())
            own = held[gap].pop()
            open_[gap] -= 1
        else:
            gap, own, new = length, new, new + 1
        sequence[i], offset[i] = own, length - gap
        if gap > size:
            held[gap - size].append(own)
            open_[gap - size] += 1
    return sequence, offset


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """parts (a written table with length and _row, which names its rows) with sequence_id and offset."""
    groups = -(-parts.count() // group) or 1
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    names = [c for c in parts.columns if c != "ids"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        sequence, offset = placed(rows["length"].to_numpy(), length)
        first = int(rows["_group"].iloc[0]) << 32  # a group's sequences are fewer than its pieces
        return rows[names].assign(sequence_id=first + sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "ids")
    out = dealt.drop("ids").groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")
    return out.join(parts.select("_row", "ids"), "_row") if "ids" in parts.columns else out


def _written_pieces(docs: DataFrame, tokenizer: str | None, *args, **more) -> DataFrame:
    return C.written(pieces(docs, tokenizer or default_tokenizer(), *args, **more).withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")


def packed(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(_written_pieces(docs, tokenizer, id_col, text_col, length), length)
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (its tokens), ids of its documents with their offsets: the packed training rows themselves."""
    parts = _written_pieces(docs, tokenizer, id_col, text_col, length, with_ids=True)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col("_id").alias("id"))))
    out = pack(parts, length).groupBy("sequence_id").agg(rows.alias("_r"))
    return out.select("sequence_id", F.flatten(F.transform("_r", lambda x: x["ids"])).alias("ids"), F.transform("_r", lambda x: F.struct(x["id"].alias("id"), x["offset"].alias("offset"))).alias("documents"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return C.settled(lambda: packed(C.table(spark, sf_dir, "documents")), "op8")
