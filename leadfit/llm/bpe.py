"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each word has a tree whose leaves are the positions of the word; a leaf holds the rank of the pair that starts there,
together with its position, or infinity. The root is then the leftmost pair of lowest rank. A merge changes three leaves
and the nodes above them, and a word is done when no leaf is left. Trees of many words of like length lie side by side
in one array and step together, so one step is a few array operations whatever the number of words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.llm.common import texts_of

WORD_END = "</w>"
# Characters whose case, composition and class are not the same in all versions of Unicode that libraries use, as RE2
# writes them, and the beginning of special tokens
UNUSUAL = r"[^\t\n\r -~\x{A1}-\x{12F}\x{131}-\x{17E}]|<\|"
# a word of the tokenizer, as RE2 writes it
WORD = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
CELLS = 1 << 16  # leaves that step together
FEW = 16  # words that are left of those that step together, from which on each goes alone
BYTES_AT_ONCE = 4 << 20  # text whose words are encoded together; a longer text goes alone
IDS_AT_ONCE = 1 << 20  # ids written out together


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class SegmentTreeBpe:
    """Encoder of words and texts; built once in each Python worker from the tokenizer's JSON text."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocabulary = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # normal form and word borders need no vocabulary
        self.rules = json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": spec["model"] | {"vocab": {}, "merges": []}})
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.specials.items()}
        shown = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.name_length = np.array([len(x) for x in shown], np.int64)
        self.name_start = np.cumsum(self.name_length) - self.name_length
        letters = byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + WORD_END] for c in letters], np.int64)
        self.base = np.int64(len(shown) + 1)
        codes = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # open addressing over a power of two of slots; the first rank given to a pair counts
        self.shift = np.uint64(64 - 18)
        self.slot_code = np.full((1 << 18) + 64, -1, np.int64)
        self.slot_rank = np.zeros((1 << 18) + 64, np.int64)
        for rank, (slot, code) in enumerate(zip(self._slot(codes).tolist(), codes.tolist())):
            while self.slot_code[slot] not in (-1, code):
                slot += 1
            if self.slot_code[slot] == -1:
                self.slot_code[slot], self.slot_rank[slot] = code, rank
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.library = None
        self.rank_of: dict[int, int] | None = None
        self.merged_of: list[int] = []

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two don't merge."""
        code = left.astype(np.int64) * self.base + right
        slot = self._slot(code)
        found = self.slot_code[slot]
        rank = np.where(found == code, self.slot_rank[slot], -1)
        open_ = np.flatnonzero((found != code) & (found != -1))
        while len(open_):
            slot[open_] += 1
            found = self.slot_code[slot[open_]]
            hit = open_[found == code[open_]]
            rank[hit] = self.slot_rank[slot[hit]]
            open_ = open_[(found != code[open_]) & (found != -1)]
        return rank

    def merge_words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (non-empty spans of data), one after another, and each word's number of ids."""
        size = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        count = np.zeros(len(length), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(size).tolist():
            rows = np.flatnonzero(size == width)
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                ids, count[part] = self._merge(data, start[part], length[part], width)
                found.append((part, ids))
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for part, ids in found:
            out[ragged(begin[part], count[part])] = ids
        return out, count

    def _merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(start)
        kind = np.int32 if len(self.merged) * width < 2**31 - 1 else np.int64
        infinite = np.iinfo(kind).max
        place = np.arange(width, dtype=np.int32)
        raw = data[np.minimum(start[:, None] + place, len(data) - 1)]
        # a last column takes what is written beyond a word
        symbol = np.full((n, width + 1), -1, np.int32)
        symbol[:, :width] = np.where(place < length[:, None], self.inner[raw], -1)
        symbol[np.arange(n), length - 1] = self.last[raw[np.arange(n), length - 1]]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * width), infinite, kind)
        pair = place[:-1] + 1 < length[:, None]
        rank = np.full(pair.shape, -1, kind)
        rank[pair] = self.ranks(symbol[:, :width - 1][pair], symbol[:, 1:width][pair])
        tree[:, width:2 * width - 1] = np.where(rank >= 0, rank * width + place[:-1], infinite)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2], out=tree[:, level:2 * level])
            level //= 2

        live = np.flatnonzero(tree[:, 1] < infinite)
        while len(live) > FEW:
            top = tree[live, 1]
            at, joined = top % width, self.merged[top // width]
            gone = after[live, at]
            following, previous = after[live, gone], before[live, at]
            inside = np.minimum(following, width)
            symbol[live, at] = joined
            symbol[live, gone] = -1
            after[live, at] = following
            before[live, inside] = at
            right = np.where(following < length[live], symbol[live, inside], -1)
            self._set(tree, width, live, gone, np.full(len(live), infinite, kind))
            self._set(tree, width, live, at, self._keys(joined, right, at, width, infinite))
            has = np.flatnonzero(previous >= 0)
            if len(has):
                rows, left = live[has], previous[has]
                self._set(tree, width, rows, left, self._keys(symbol[rows, left], joined[has], left, width, infinite))
            live = live[tree[live, 1] < infinite]
        for i in live.tolist():
            symbol[i, :width] = self._merge_alone(symbol[i].tolist(), after[i].tolist(), before[i].tolist(), tree[i].tolist(), width, int(length[i]), infinite)
        kept = symbol >= 0
        return symbol[kept], kept.sum(axis=1)

    def _merge_alone(self, symbol: list[int], after: list[int], before: list[int], tree: list[int], width: int, length: int, infinite: int) -> list[int]:
        """The symbols of one word after all its merges, from where its tree stands, by plain numbers."""
        if self.rank_of is None:
            used = self.slot_code >= 0
            self.rank_of = dict(zip(self.slot_code[used].tolist(), self.slot_rank[used].tolist()))
            self.merged_of = self.merged.tolist()
        rank_of, base, merged = self.rank_of, int(self.base), self.merged_of

        def put(leaf: int, key: int) -> None:
            node = leaf + width
            tree[node] = key
            while node > 1:
                least = min(key, tree[node ^ 1])
                node >>= 1
                if tree[node] == least:
                    return  # nothing changes above
                tree[node] = key = least

        def key(left: int, right: int, at: int) -> int:
            rank = rank_of.get(left * base + right)
            return infinite if rank is None else rank * width + at

        while tree[1] < infinite:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            following, previous = after[gone], before[at]
            symbol[at], symbol[gone], after[at] = merged[rank], -1, following
            put(gone, infinite)
            if following < length:
                before[following] = at
                put(at, key(merged[rank], symbol[following], at))
            else:
                put(at, infinite)
            if previous >= 0:
                put(previous, key(symbol[previous], merged[rank], previous))
        return symbol[:width]

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int, infinite: int) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where((rank >= 0) & (right >= 0), rank * width + at, infinite)

    @staticmethod
    def _set(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        while node[0] > 1:  # all leaves lie equally deep
            other = tree[rows, node ^ 1]
            value = np.minimum(value, other)
            node = node >> 1
            tree[rows, node] = value

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids; a null text has none."""
        plain = ~pc.fill_null(pc.match_substring_regex(texts, UNUSUAL), True).to_numpy(zero_copy_only=False)
        usual, usual_count = self._encode_plain(texts.filter(pa.array(plain)))
        other = np.flatnonzero(~plain)
        if not len(other):
            return usual, usual_count
        unusual, unusual_count = self._encode_unusual([t or "" for t in texts.filter(pa.array(~plain)).to_pylist()])
        count = np.zeros(len(plain), np.int64)
        count[plain], count[other] = usual_count, unusual_count
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        out[ragged(begin[plain], usual_count)] = usual
        out[ragged(begin[other], unusual_count)] = unusual
        return out, count

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every distinct piece between white space is encoded once for all texts given."""
        pieces = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
        per_text = np.diff(pieces.offsets.to_numpy())
        coded = pieces.flatten().dictionary_encode()
        piece = coded.indices.to_numpy()
        words = pc.split_pattern(pc.replace_substring_regex(coded.dictionary, WORD, r"\1 "), " ")
        per_piece = np.diff(words.offsets.to_numpy()) - 1  # each word has a blank behind it
        flat = words.flatten().dictionary_encode()
        code = flat.indices.to_numpy()
        first = words.offsets.to_numpy()[:-1] - words.offsets.to_numpy()[0]
        data, start, length = spans(flat.dictionary)
        ids = np.zeros(0, np.int32)
        count = np.zeros(len(length), np.int64)
        real = np.flatnonzero(length > 0)
        ids, count[real] = self.merge_words(data, start[real], length[real])
        begin = np.cumsum(count) - count
        # ids of each distinct piece, then of each text
        word = code[ragged(first, per_piece)]
        piece_ids = ids[ragged(begin[word], count[word])]
        piece_count = sums(count[word], per_piece)
        piece_begin = np.cumsum(piece_count) - piece_count
        out = [np.zeros(0, np.int32)]
        text_count = sums(piece_count[piece], per_text)
        for i in range(0, len(piece), IDS_AT_ONCE):
            part = piece[i:i + IDS_AT_ONCE]
            out.append(piece_ids[ragged(piece_begin[part], piece_count[part])])
        return np.concatenate(out), text_count

    def _encode_unusual(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normal form and word borders by the tokenizer's own tables; special tokens stand for themselves."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules)
        normal, borders = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        place: dict[str | int, int] = {}
        words, per_text = [], []
        for text in texts:
            before, end = len(words), 0
            marks = [*self.special_pattern.finditer(text)] if self.special_pattern else []
            for m in [*marks, None]:
                part = text[end:m.start() if m else len(text)]
                words += [place.setdefault(w, len(place)) for w, _ in borders(normal(part)) if w]
                if m:
                    words.append(place.setdefault(self.specials[m.group()], len(place)))
                    end = m.end()
            per_text.append(len(words) - before)
        raw = [bytes([self.letter_byte[c] for c in w]) if isinstance(w, str) else b"" for w in place]
        length = np.array([len(w) for w in raw], np.int64)
        start = np.cumsum(length) - length
        real = np.flatnonzero(length > 0)
        got, got_count = self.merge_words(np.frombuffer(b"".join(raw), np.uint8), start[real], length[real])
        count = np.ones(len(raw), np.int64)
        count[real] = got_count
        begin = np.cumsum(count) - count
        ids = np.array([0 if isinstance(w, str) else w for w in place], np.int32)[np.repeat(np.arange(len(raw)), count)]
        ids[ragged(begin[real], got_count)] = got
        word = np.array(words, np.int64)
        return ids[ragged(begin[word], count[word])], sums(count[word], np.array(per_text, np.int64))

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids in UTF-8, special tokens included: tokens joined by one blank, as without a decoder rule."""
        out = [
            self.name_bytes[ragged(self.name_start[part], self.name_length[part])].tobytes()
            for part in (ids[i:i + IDS_AT_ONCE] for i in range(0, len(ids), IDS_AT_ONCE))
        ]
        return b"".join(out)[:-1]


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] places, then the same for the next."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of values whose lengths are counts."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array with the start and length of each value."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8), at[:-1], np.diff(at)


_ENCODERS: dict[str, SegmentTreeBpe] = {}


def encoder_of(shared) -> SegmentTreeBpe:
    """The worker's encoder for a broadcast tokenizer text, built once."""
    text = shared.value
    key = hashlib.sha1(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentTreeBpe(text)
    return _ENCODERS[key]


def share_tokenizer(spark: SparkSession, tokenizer_path: str):
    """The tokenizer file, read on the driver and sent to the executors once (a vocabulary: some MB, whatever the corpus)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded_portions(encoder: SegmentTreeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a text column, their ids one after another, and the number of ids of each row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        first = 0
        while first < len(size):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + BYTES_AT_ONCE, "right")))
            rows = batch.slice(first, last - first)
            yield rows, *encoder.encode(rows.column("text"))
            pa.default_memory_pool().release_unused()
            first = last


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) of every row of docs, its whole text encoded and decoded.

    ids is an array of the token ids and decoded the text of those ids; with_ids=False leaves both out.
    A null or empty text has no tokens and decodes to an empty text; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives an empty one; other columns are ignored. The work is one pass without a shuffle.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for rows, ids, count in encoded_portions(encoder, batches):
            end = np.cumsum(count)
            hashes, texts, text_hashes = [], [], []
            for i, j in zip((end - count).tolist(), end.tolist()):
                hashes.append(hashlib.sha256(ids[i:j].astype("<u4").tobytes()).hexdigest())
                text = encoder.decode(ids[i:j])
                text_hashes.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    texts.append(text.decode())
            columns = [rows.column("doc_id"), pa.array(count), pa.array(hashes, pa.string()), pa.array(text_hashes, pa.string())]
            if with_ids:
                columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return texts_of(docs).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, decoded) from rows with doc_id and an array column ids; null ids decode to an empty text."""
    shared = share_tokenizer(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            texts = [encoder.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
