"""Token ids in training order: a keyed Feistel permutation places every sequence, fixed-stride shards hold them."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import running, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's own tokenizer cuts text into pieces (a fixed value of that public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: What the pattern takes for white space (its class s), but for a space or a line feed.
OTHER_WHITE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = re.compile(f"[{OTHER_WHITE}]")
SPACES = re.compile(f"([ \n{OTHER_WHITE}]+)")


def even(text: str) -> bool:
    """Whether all white space is single spaces or line feeds between words."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text))


def vocabulary_ranks(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of byte sequences in the order in which they merge, and ids of the special tokens that a text is searched for: of a
    file of ranks (which has none), or of a byte-level JSON file, whose ids must be in the order of its merges."""
    if not vocabulary.endswith(".json"):
        with open(vocabulary, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(vocabulary, encoding="utf-8") as f:
        data = json.load(f)
    # Bytes that are printable Latin-1 characters stand for themselves; the others have the characters from 256 on, in order.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    known = data["model"]["vocab"]
    merged = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in data["model"]["merges"]]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    if merged != sorted(merged) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
        raise ValueError(f"{vocabulary}: ids are not in the order of merges, or special tokens take what is beside them")
    return {bytes(byte[c] for c in token): i for token, i in known.items() if token not in special}, special


class Encoder:
    """Ids of whole texts as little-endian 16-bit integers. A piece of the pattern never reaches over white space but for a
    single space before it; so texts are encoded word by word, and words of up to 64 characters are remembered, up to
    `most` of them after a space, and as many after a line feed and at the start of a text.

    White space is cut by a linear scan, as the pattern cuts it: of a run of n before a word, n - 1 are one piece and the
    last goes with the word if it is a space; a run that ends the text is one piece. The pattern itself would overflow its
    stack on a run of a million."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        import tiktoken

        ranks, special = vocabulary_ranks(vocabulary)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {token: np.array([i], "<u2").tobytes() for token, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        encode = self.encoding.encode_ordinary

        class Known(dict):
            def __init__(self, before: str):
                self.before = before

            def __missing__(self, word: str) -> bytes:
                got = np.array(encode(self.before + word), "<u2").tobytes()
                if len(word) <= 64:
                    if len(self) >= most:
                        self.clear()
                    self[word] = got
                return got

        self.first, self.line, self.space = Known(""), Known("\n"), Known(" ")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and any(token in text for token in self.special):
            return b"".join(self.special.get(part) or self.ordinary(part) for part in self.cut.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if not even(text):
            return self.scanned(text)
        out: list[bytes] = []
        head = self.first
        for line in text.split("\n"):
            ws = line.split(" ")
            out.append(head[ws[0]])
            ws[0:1] = ()
            out.extend(map(self.space.__getitem__, ws))
            head = self.line
        return b"".join(out)

    def scanned(self, text: str) -> bytes:
        """Any white space: parts are words and runs in turn, the first a word, which may be empty."""
        parts = SPACES.split(text)
        out = [self.first[parts[0]]] if parts[0] else []
        for run, word in zip(parts[1::2], parts[2::2], strict=True):
            if not word:  # the run ends the text
                out.append(self.white(run))
                continue
            if len(run) > 1:
                out.append(self.white(run[:-1]))
            last = run[-1]
            if last == " ":
                out.append(self.space[word])
            elif last == "\n":
                out.append(self.line[word])
            else:
                out += [self.white(last), self.first[word]]
        return b"".join(out)

    def white(self, run: str) -> bytes:
        return np.array(self.encoding._encode_single_piece(run), "<u2").tobytes()


def round_key(key: int, r: int) -> np.uint64:
    return np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of 0..n-1. It permutes the next power of four; a value outside walks on along its cycle
    until it is inside, which keeps the map one to one."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(rounds):
            left, right = right, left ^ mixed(right, round_key(key, r))
        return (left << shift) | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(row, id, tie, ids): a number of the row, and the ids of the text and an end mark. The vocabulary's file is shipped
    with the job."""
    end = np.array([END], "<u2").tobytes()
    docs.sparkSession.sparkContext.addFile(vocabulary)
    file = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(SparkFiles.get(file))
        for b in batches:
            ids = pa.array([encode(t) + end for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], names=["row", "id", "tie", "ids"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "row long, id long, tie long, ids binary")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, shard_rows: int = 2048, key: int = 20240229, vocabulary: str = VOCABULARY, part_shards: int = 16, bucket_rows: int = 50_000) -> DataFrame:
    """Every sequence of docs at its place in the training order: slot, shard, byte_offset, id, seq, n_tokens, tokens.

    A document's ids and an end mark are cut into sequences of `length` ids, the last one filled up with end marks
    (n_tokens says how many are real). Documents come in the order of a hash of id and text, and their sequences are
    numbered in it; the Feistel permutation under `key` sends number to slot, so slots are 0..n-1 without gaps, whatever the
    partitions. tokens is binary, 2 * length bytes little-endian; shard = slot div shard_rows, at byte_offset within it.
    Each partition holds the slots of part_shards whole shards, in order: partitions grow in number with the input.

    Defined cases: null and empty texts are one sequence of one end mark; repeated rows and null ids are documents like
    any other (null first), each with numbers of its own; an empty table gives no rows. Other columns are ignored.
    """
    return in_order(docs, id_col, text_col, length, shard_rows, key, vocabulary, part_shards, bucket_rows)[0]


def in_order(docs: DataFrame, id_col: str, text_col: str, length: int, shard_rows: int, key: int, vocabulary: str, part_shards: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """The rows of training_order and how many there are."""
    own = written(tokenize(docs, id_col, text_col, vocabulary))
    sized = own.select("row", "id", "tie", F.ceil(F.length("ids") / (2 * length)).cast("long").alias("k"))
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sequences")).first()
    n = total["sequences"] or 0
    # Equal rows may take each other's numbers, so that of the row may come last: no group of equal rows meets in one task.
    first = running(sized.withColumn("hash", F.xxhash64("id", "tie")), ["hash", "id", "tie", "row"], ["k"], total["n"], bucket_rows).select("row", F.col("before_k").alias("first"))
    numbered = own.select("row", "id", "ids").join(first, "row")
    fill = np.array([END], "<u2").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                ids, number, seq, real, tokens = [], [], [], [], []
                for i, x, first_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    k = -(-len(x) // (2 * length))
                    for s in range(k):
                        piece = x[2 * length * s : 2 * length * (s + 1)]
                        ids.append(i)
                        number.append(first_ + s)
                        seq.append(s)
                        real.append(len(piece) // 2)
                        tokens.append(piece + fill * (length - len(piece) // 2))
                slot = feistel(np.array(number, np.int64), n, key) if number else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(real, pa.int32()), pa.array(tokens, pa.binary())], names=["slot", "id", "seq", "n_tokens", "tokens"])

    placed = numbered.select("id", "ids", "first").mapInArrow(cut_up, "slot long, id long, seq int, n_tokens int, tokens binary")
    # Slots are dense and uniform: even ranges of them need no sampling pass over the rows.
    width = part_shards * shard_rows
    placed = placed.repartitionById(max(1, -(-n // width)), F.expr(f"cast(slot div {width} as int)")).sortWithinPartitions("slot")
    return placed.select("slot", F.expr(f"cast(slot div {shard_rows} as long)").alias("shard"), F.expr(f"cast(slot % {shard_rows} * {2 * length} as long)").alias("byte_offset"), F.col("id").alias(id_col), "seq", "n_tokens", "tokens"), n


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:09}.bin"


def identity_of(docs: DataFrame, id_col: str, text_col: str, **settings) -> dict:
    """What a folder of shards is made of: the documents (how many, and two sums of their hashes, whatever their order) and settings."""
    text = F.col(text_col).cast("string")
    row = [F.col(id_col).cast("long"), text, F.col(id_col).isNull(), text.isNull()]
    total = lambda *more: F.coalesce(F.sum(F.xxhash64(*row, *more).cast("decimal(38,0)")), F.lit(0)).cast("string")
    n, one, two = docs.agg(F.count(F.lit(1)), total(), total(F.lit("second"))).first()
    return {"documents": n, "hashes": [one, two], **settings}


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, shard_rows: int = 2048, key: int = 20240229, vocabulary: str = VOCABULARY, part_shards: int = 16, bucket_rows: int = 50_000, overwrite: bool = False) -> int:
    """The training order of docs under path (a URI): a file for each shard with the tokens of its slots one after the other, so that slot
    s is at s % shard_rows times the stride in the file of s div shard_rows; a table of the shards' checksums; and a manifest.

    What the folder is made of (documents, key, length and so on) is written first. A folder of another identity is an error, or, with
    `overwrite`, emptied: shards of another corpus, key or length are never kept. Each task writes its shards from its sorted slots, to a
    file of a temporary name that is renamed when it is whole: a lost or repeated task leaves no half shard. Shards that are there at their
    full size are passed over, so a broken run goes on where it ended. Returns the number of shards written by this run."""
    target, folder = fs.FileSystem.from_uri(path)
    identity = identity_of(docs, id_col, text_col, length=length, shard_rows=shard_rows, key=key, vocabulary=vocabulary.rsplit("/", 1)[-1])
    claim(target, folder, identity, overwrite)
    ordered, slots = in_order(docs, id_col, text_col, length, shard_rows, key, vocabulary, part_shards, bucket_rows)
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        done: list[tuple[int, int, int, int]] = []
        shard, out, temporary, expected, skip, rows, crc = -1, None, "", 0, False, 0, 0

        def close() -> None:
            if shard < 0:
                return
            if not skip:
                out.close()
                files.move(temporary, shard_path(at, shard))
            done.append((shard, rows, crc, int(not skip)))

        for b in batches:
            for slot, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if slot // shard_rows != shard:
                    close()
                    shard, rows, expected, crc = slot // shard_rows, 0, slot // shard_rows * shard_rows, 0
                    info = files.get_file_info(shard_path(at, shard))
                    skip = info.type == fs.FileType.File and info.size == stride * min(shard_rows, slots - shard * shard_rows)
                    if not skip:
                        temporary = f"{at}/.shard-{shard:09}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(temporary)
                if slot != expected or len(tokens) != stride:
                    raise ValueError(f"slot {slot} is out of order or of another length")
                expected, rows, crc = expected + 1, rows + 1, zlib.crc32(tokens, crc)
                if not skip:
                    out.write(tokens)
        close()
        cols = list(zip(*done, strict=True)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "rows", "crc32", "written"])

    sums = f"{path.rstrip('/')}/_checksums"
    ordered.select("slot", "tokens").mapInArrow(run, "shard long, rows long, crc32 long, written long").write.mode("overwrite").parquet(sums)
    rows, made, shards = docs.sparkSession.read.parquet(sums).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("written"), F.lit(0)), F.count(F.lit(1))).first()
    if rows != slots:
        raise RuntimeError(f"{rows} of {slots} slots were written")
    with target.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"slots": slots, "shards": shards, "shard_rows": shard_rows, "stride": stride, "identity": identity}).encode())
    return made


def claim(target: fs.FileSystem, folder: str, identity: dict, overwrite: bool) -> None:
    """Make folder that of this identity."""
    target.create_dir(folder, recursive=True)
    own = f"{folder}/identity.json"
    there = [f.path for f in target.get_file_info(fs.FileSelector(folder)) if re.search(r"/(\.?shard-|manifest\.json|identity\.json)", f.path)]
    if target.get_file_info(own).type == fs.FileType.File and json.loads(target.open_input_stream(own).read()) == identity:
        return
    if there and not overwrite:
        raise ValueError(f"{folder} holds shards of another corpus, key or length")
    for p in there:
        target.delete_file(p)
    with target.open_output_stream(f"{own}.new") as f:
        f.write(json.dumps(identity).encode())
    target.move(f"{own}.new", own)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """The shards whose files are missing or not what was written: shard and why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        for b in batches:
            bad = []
            for shard, crc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if files.get_file_info(shard_path(at, shard)).type != fs.FileType.File:
                    bad.append((shard, "missing"))
                    continue
                got = 0
                with files.open_input_stream(shard_path(at, shard)) as f:
                    while data := f.read(1 << 20):
                        got = zlib.crc32(data, got)
                if got != crc:
                    bad.append((shard, "changed"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in bad], pa.int64()), pa.array([x[1] for x in bad], pa.string())], names=["shard", "why"])

    return spark.read.parquet(f"{path.rstrip('/')}/_checksums").select("shard", "crc32").mapInArrow(run, "shard long, why string")


def read_slot(path: str, slot: int) -> np.ndarray:
    """The ids of one slot, by its offset alone."""
    files, at = fs.FileSystem.from_uri(path)
    m = json.loads(files.open_input_stream(f"{at}/manifest.json").read())
    with files.open_input_file(shard_path(at, slot // m["shard_rows"])) as f:
        f.seek(slot % m["shard_rows"] * m["stride"])
        return np.frombuffer(f.read(m["stride"]), "<u2")


def read_from(spark: SparkSession, path: str, slot: int) -> DataFrame:
    """The rest of a run of training from a slot on, as (slot, tokens): shards before it are not opened, and its own is
    read from the slot's offset. Rows come in order within a partition of one shard each."""
    files, at = fs.FileSystem.from_uri(path)
    m = json.loads(files.open_input_stream(f"{at}/manifest.json").read())
    size, stride = m["shard_rows"], m["stride"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            for shard in b.column(0).to_pylist():
                begin = max(slot, shard * size)
                with own.open_input_file(shard_path(folder, shard)) as f:
                    f.seek(begin % size * stride)
                    while data := f.read(256 * stride):
                        k = len(data) // stride
                        yield pa.RecordBatch.from_arrays([pa.array(range(begin, begin + k), pa.int64()), pa.array([data[stride * i : stride * (i + 1)] for i in range(k)], pa.binary())], names=["slot", "tokens"])
                        begin += k

    some = max(m["shards"] - slot // size, 0)
    return spark.range(slot // size, slot // size + some, numPartitions=max(1, some)).mapInArrow(run, "slot long, tokens binary")
