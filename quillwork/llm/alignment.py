"""Alignment of two tokenizers over the same bytes, with an associative fragment for very long documents.

Both tokenizers end a token before every single blank between two visible characters, so a text cut there
is encoded piece by piece with the same ids. The different words of many texts are therefore encoded
and aligned once, as arrays. A document over ``LONG_BYTES`` is cut into pieces at such blanks, and a piece's tokens
into ranges of bytes, wherever those end. Each range becomes a :class:`Fragment`; fragments compose
associatively, so a document's are composed in a tree of Spark tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import stored, text_list
from quillwork.llm.encoding import ByteEncoder, byte_names
from quillwork.llm.hashing import by_bytes
from quillwork.llm.registry import llm_query
from quillwork.sources.tables import table

#: Documents of more bytes are cut into pieces of about half as many.
LONG_BYTES = 1 << 18
#: Bytes of a fragment of a long document.
RANGE_BYTES = 1 << 16
#: Fragments that one task composes into one.
FAN_IN = 16
#: Different words that a task counts before it encodes them.
WORDS_AT_ONCE = 1_000_000
#: Bytes of texts whose different words a task aligns together.
SLICE_BYTES = 1 << 23
#: Id pairs whose counts are sent to every worker, 16 bytes each; the rest are joined.
SENT_PAIRS = 4_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[\s▁]")
_SHIFT = 32


def token_bytes_a(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    value = byte_names()
    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
    return out


def token_bytes_b(path: str) -> list[bytes]:
    """Bytes of every id of a piece vocabulary with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


@dataclass
class Tokens:
    """Ids of two tokenizers with the byte at which each token ends; both end together at the end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where both sides end; where one does, which ends the stretches that are one link each; the links' id pairs.

        In a pair the a id stands above, the b id in the lower bits.
        """
        marks = np.zeros((2, max(int(x[-1]) if len(x) else 0 for x in (self.a_ends, self.b_ends)) + 1), dtype=bool)
        marks[0, self.a_ends] = True
        marks[1, self.b_ends] = True
        points = np.flatnonzero(marks[0] | marks[1])
        a_here, b_here = marks[0, points], marks[1, points]
        # a point belongs to the token of each side that ends there or next
        a, b = self.a[np.cumsum(a_here) - a_here], self.b[np.cumsum(b_here) - b_here]
        return points[a_here & b_here], points, a << _SHIFT | b


def rendered(a: list[str], a_cuts: list[int], b: list[str], b_cuts: list[int]) -> list[str]:
    """Groups between neighbouring cuts: ids of a, a bar, ids of b."""
    join = ",".join
    return [
        f"{join(a[p:q])}|{join(b[r:s])}"
        for p, q, r, s in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:])
    ]


@dataclass
class Fragment:
    """What a range of bytes knows of its groups, as an element of a monoid.

    Tokens are (id, byte of the document at which it ends). ``prefix`` holds the tokens up to the first place where
    both sides are known to end, that is all of them while none is known; groups between the first
    and the last such place are closed and only counted; ``suffix`` holds the tokens after it. What composition closes
    is kept as ``joints``: the number of the fragment before whose closed groups it stands, groups, text.
    """

    prefix_a: list = field(default_factory=list)
    prefix_b: list = field(default_factory=list)
    closed: bool = False
    suffix_a: list = field(default_factory=list)
    suffix_b: list = field(default_factory=list)
    joints: list = field(default_factory=list)

    @staticmethod
    def _cuts(a: list, b: list) -> tuple[list[int], list[int]]:
        """How many tokens of each side lie up to each place where both end."""
        ends = {end: i + 1 for i, (_, end) in enumerate(b)}
        met = [(i + 1, ends[end]) for i, (_, end) in enumerate(a) if end in ends]
        return [p for p, _ in met], [q for _, q in met]

    @classmethod
    def of(cls, a: list, b: list) -> tuple[Fragment, list[str]]:
        """The fragment of the tokens that begin in a range, and its closed groups."""
        p, q = cls._cuts(a, b)
        if not p:
            return cls(a, b), []
        groups = rendered([str(i) for i, _ in a], p, [str(i) for i, _ in b], q)
        return cls(a[: p[0]], b[: q[0]], True, a[p[-1] :], b[q[-1] :]), groups

    def then(self, other: Fragment, at: int) -> Fragment:
        """This fragment and the one after it, which begins with fragment number ``at`` of the document."""
        left_a, left_b = (self.suffix_a, self.suffix_b) if self.closed else (self.prefix_a, self.prefix_b)
        middle, groups = Fragment.of(left_a + other.prefix_a, left_b + other.prefix_b)
        joints = self.joints + other.joints
        if self.closed and middle.closed:  # what stands before the first common end is a group, too
            first = rendered([str(i) for i, _ in middle.prefix_a], [0, len(middle.prefix_a)], [str(i) for i, _ in middle.prefix_b], [0, len(middle.prefix_b)])
            groups = first + groups
        if groups:
            joints = joints + [(at, len(groups), ";".join(groups))]
        open_a, open_b = (middle.suffix_a, middle.suffix_b) if middle.closed else (middle.prefix_a, middle.prefix_b)
        if other.closed:
            # the first common end of ``other`` ends the middle, so nothing is open there
            open_a, open_b = other.suffix_a, other.suffix_b
        if self.closed:
            return Fragment(self.prefix_a, self.prefix_b, True, open_a, open_b, joints)
        if not middle.closed:
            return Fragment(open_a, open_b, False, [], [], joints)
        return Fragment(middle.prefix_a, middle.prefix_b, True, open_a, open_b, joints)


@dataclass
class Words:
    """Distinct words and, as arrays in the same order, their tokens of each side, groups and links.

    The links of word i are ``links[link_ends[i - 1] : link_ends[i]]``. A word that one side does not spell
    byte for byte has none of them.
    """

    place: dict[str, int]
    unspelled: set[int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    link_ends: np.ndarray
    text: list[str]

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.link_ends, prepend=0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a number of each link, by word."""
        total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])[np.concatenate([[0], self.link_ends])]
        return np.diff(total)


class Aligner:
    """Encodes with both tokenizers and aligns the tokens of many words at once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteEncoder(a_path, marks=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = token_bytes_a(a_path), token_bytes_b(b_path)
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # what stands behind an id: another of its side, the other side, the next group
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.comma, self.bar, self.semicolon = (np.array([n + sign for n in names], dtype=object) for sign in ",|;")

    def tokens(self, texts: list[str]) -> tuple[Tokens, list[bool]]:
        """Tokens of a blank and each text, in a row; a text that one side does not spell has none."""
        a = [np.frombuffer(self.a.encode(f" {t}"), dtype="<u4") for t in texts]
        b = self.b.encode(texts, num_threads=1)
        fine = [True] * len(texts)
        want = "".join([f" {t}" for t in texts]).encode()
        if b"".join([self.b_bytes[i] for ids in b for i in ids]) != want or b"".join([self.a_bytes[i] for ids in a for i in ids.tolist()]) != want:
            for k, text in enumerate(texts):
                spelled = f" {text}".encode()
                fine[k] = b"".join([self.b_bytes[i] for i in b[k]]) == spelled and b"".join([self.a_bytes[i] for i in a[k].tolist()]) == spelled
            a, b = ([ids for ids, ok in zip(side, fine) if ok] for side in (a, b))
        a = np.concatenate(a).astype(np.int64) if a else np.empty(0, np.int64)
        b = np.fromiter(chain.from_iterable(b), dtype=np.int64)
        return Tokens(a, np.cumsum(self.a_size[a]), b, np.cumsum(self.b_size[b])), fine

    def _texts(self, tokens: Tokens, shared: np.ndarray, ends: np.ndarray) -> list[str]:
        """Groups of each word as text: both sides' ids in turn, with the sign that follows each."""
        a_group, b_group = np.searchsorted(shared, tokens.a_ends), np.searchsorted(shared, tokens.b_ends)
        a_last, b_last = np.isin(tokens.a_ends, shared, assume_unique=True), np.isin(tokens.b_ends, shared, assume_unique=True)
        a_count, b_count = np.cumsum(np.bincount(a_group, minlength=len(shared))), np.cumsum(np.bincount(b_group, minlength=len(shared)))
        parts = np.empty(len(tokens.a) + len(tokens.b), dtype=object)
        before = np.concatenate([[0], b_count])  # the other side's ids in the groups before
        parts[np.arange(len(tokens.a)) + before[a_group]] = np.where(a_last, self.bar[tokens.a], self.comma[tokens.a])
        parts[np.arange(len(tokens.b)) + a_count[b_group]] = np.where(b_last, self.semicolon[tokens.b], self.comma[tokens.b])
        cuts = (np.searchsorted(tokens.a_ends, ends, "right") + np.searchsorted(tokens.b_ends, ends, "right")).tolist()
        flat, begin, out = parts.tolist(), 0, []
        for end in cuts:
            out.append("".join(flat[begin:end]))
            begin = end
        return out

    def words(self, words: list[str], texts: bool = True) -> Words:
        """What distinct words align to; with ``texts`` also their groups as text, each with a semicolon behind it."""
        plain, odd = [], []
        for w in words:
            (odd if _ODD.search(w) else plain).append(w)
        rows = [plain[i : i + 64] for i in range(0, len(plain), 64)] + [[w] for w in odd]
        tokens, fine = self.tokens([" ".join(r) for r in rows])
        known = [w for row, ok in zip(rows, fine) if ok for w in row]
        # a row of plain words is spelled as a whole unless one of them is not
        doubtful = [w for row, ok in zip(rows, fine) if not ok and len(row) > 1 for w in row]
        unspelled = [row[0] for row, ok in zip(rows, fine) if not ok and len(row) == 1]
        for word in doubtful:
            (known if self.tokens([word])[1][0] else unspelled).append(word)
        if doubtful:
            tokens, _ = self.tokens(known)
        ends = np.cumsum(np.array([len(w.encode()) + 1 for w in known], dtype=np.int64))
        shared, points, links = tokens.met()
        at = [np.searchsorted(x, ends, "right") for x in (tokens.a_ends, tokens.b_ends, shared, points)]
        none = np.zeros(len(unspelled), dtype=np.int64)
        n_a, n_b, n_groups = (np.concatenate([np.diff(x, prepend=0), none]) for x in at[:3])
        place = {w: i for i, w in enumerate(known + unspelled)}
        return Words(
            place, set(range(len(known), len(place))), n_a, n_b, n_groups, links,
            np.concatenate([at[3], none + len(points)]), self._texts(tokens, shared, ends) + [""] * len(unspelled) if texts else [],
        )


def words_of(texts: list[str]) -> list[list[str]]:
    """Each text cut at its single blanks between visible characters; where all blanks are such, the plain split does that."""
    out = []
    for text in texts:
        line = text.replace("\n", "n")
        if " ".join(line.split()) == line and " \n" not in text and "\n " not in text:
            out.append(text.split(" ") if text else [])
        else:
            out.append(_CUT.split(text))
    return out


def count_links(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair, n``: how many links of all texts hold each id pair.

    Each task counts its words first and encodes every different word once, at most ``WORDS_AT_ONCE`` of them together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        seen: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            words = aligner.words(list(seen), texts=False)
            each = np.array([seen[w] for w in words.place], dtype=np.int64)
            pairs, place = np.unique(words.links, return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, place, np.repeat(each, words.n_links))
            for start in range(0, len(pairs), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[part]), pa.array(total[part])], names=["pair", "n"])
            seen.clear()

        for batch in by_bytes(batches, 0, 1 << 22):
            for text, words in zip(texts_ := text_list(batch.column(0)), words_of(texts_)):
                # a text with this sign is spelled otherwise by the pieces, so it has no tokens at all
                if "▁" not in text:
                    seen.update(words)
            if len(seen) > WORDS_AT_ONCE:
                yield from counted()
        if seen:
            yield from counted()

    counted_ = texts.select(F.col(texts.columns[0]).alias("text")).mapInArrow(count, "pair long, n long")
    return counted_.groupBy("pair").agg(F.sum("n").alias("n"))


_ROW = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_REST = "array<struct<pair:long,m:long>>"
_FRAGMENT = "prefix_a array<long>, prefix_b array<long>, closed boolean, suffix_a array<long>, suffix_b array<long>, joints array<struct<at:long,n:int,text:string>>"
_LONGS = pa.list_(pa.int64())
_REST_TYPE = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))
_JOINTS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("text", pa.string())]))
_FRAGMENT_TYPES = [_LONGS, _LONGS, pa.bool_(), _LONGS, _LONGS, _JOINTS]


class PairCounts:
    """Counts of the id pairs sent to the workers, and which of them are the highest of their b id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.counts, self.best = pairs[order], counts[order], best[order]

    def look_up(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each link its pair's count, whether that is the highest, and whether the pair is here at all."""
        if not len(self.pairs):
            none = np.zeros(len(links), dtype=np.int64)
            return none, none.astype(bool), none.astype(bool)
        at = np.minimum(np.searchsorted(self.pairs, links), len(self.pairs) - 1)
        here = self.pairs[at] == links
        return np.where(here, self.counts[at], 0), self.best[at] & here, here


def _rest_of(links: np.ndarray) -> list[tuple[int, int]]:
    pairs, numbers = np.unique(links, return_counts=True)
    return list(zip(pairs.tolist(), numbers.tolist()))


def _whole_documents(docs: DataFrame, a_path: str, b_path: str, counts) -> DataFrame:
    """Result rows of documents that are worked out in one go; ``rest`` holds the links whose pairs were not sent."""
    names = [f.split()[0] for f in _ROW.split(", ")] + ["rest"]
    types = [pa.int64()] * 8 + [pa.string(), _REST_TYPE]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(a_path, b_path), counts.value
        for batch in by_bytes(batches, 2, SLICE_BYTES):
            cut = words_of(text_list(batch.column(2)))
            words = aligner.words(list(dict.fromkeys(chain.from_iterable(cut))))
            count, best, here = known.look_up(words.links)
            partial, ends, text = not here.all(), [0, *words.link_ends.tolist()], words.text
            places = [list(map(words.place.__getitem__, own)) for own in cut]
            flat = np.fromiter(chain.from_iterable(places), dtype=np.int64)
            edges = np.concatenate([[0], np.cumsum([len(at) for at in places])]).astype(np.int64)
            facts = (words.n_a, words.n_b, words.n_groups, words.n_links, words.sums(best), words.sums(count))
            sums = np.array([np.diff(np.concatenate([[0], np.cumsum(x[flat])])[edges]) for x in facts]).T.tolist()
            rows = []
            for uid, key, at, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places, sums):
                if not at or (words.unspelled and not words.unspelled.isdisjoint(at)):
                    rows.append((uid, key, 0, 0, 0, 0, 0, 0, "", []))
                    continue
                rest = []
                if partial:
                    spans = [slice(ends[i], ends[i + 1]) for i in at]
                    rest = _rest_of(np.concatenate([words.links[x][~here[x]] for x in spans]))
                digest = hashlib.sha256("".join([text[i] for i in at])[:-1].encode()).hexdigest()
                rows.append((uid, key, *total, digest, rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("uid", "doc_id", "text").mapInArrow(measure, f"{_ROW}, rest {_REST}")


def _cut_long(docs: DataFrame, piece_bytes: int) -> DataFrame:
    """``uid, doc_id, start, text``: pieces of long documents, cut at single blanks between visible characters.

    ``start`` is the byte of the blank before the piece, in a blank and the text. A stretch without such a
    blank stays whole, as the tokenizers need it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                begin = place = 0
                while begin <= len(text) and begin >= 0:
                    found = _CUT.search(text, min(begin + piece_bytes // 2, len(text)))
                    part = text[begin : found.start()] if found else text[begin:]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid], pa.int64()), pa.array([key], pa.int64()), pa.array([place], pa.int64()), pa.array([part], pa.string())],
                        names=["uid", "doc_id", "start", "text"],
                    )
                    place += len(part.encode()) + 1
                    begin = found.end() if found else -1

    return docs.select("uid", "doc_id", "text").mapInArrow(cut, "uid long, doc_id long, start long, text string")


def _flat(tokens: list[tuple[int, int]]) -> list[int]:
    return [x for token in tokens for x in token]


def _fragments(pieces: DataFrame, a_path: str, b_path: str, counts, range_bytes: int) -> DataFrame:
    """Fragments of the byte ranges of every piece, their closed groups as text, and what only adds up."""
    facts = "n_a long, n_b long, n_links long, n_best long, count_sum long, unspelled boolean"
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.string()] + [pa.int64()] * 5 + [pa.bool_(), _REST_TYPE] + _FRAGMENT_TYPES
    schema = f"uid long, doc_id long, seq long, groups int, text string, {facts}, rest {_REST}, {_FRAGMENT}"
    names = [f.strip().split()[0] for f in schema.replace("pair:long,m:long", "").replace("at:long,n:int,text:string", "").split(",") if f.strip()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(a_path, b_path), counts.value
        for batch in batches:
            for uid, key, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = _CUT.split(text)
                tokens, fine = aligner.tokens([" ".join(words[i : i + 64]) for i in range(0, len(words), 64)])
                links = tokens.met()[2]
                count, best, here = known.look_up(links)
                sums = (len(tokens.a), len(tokens.b), len(links), int(best.sum()), int(count.sum()), not all(fine))
                rest = _rest_of(links[~here])
                a_starts, b_starts = tokens.a_ends - aligner.a_size[tokens.a], tokens.b_ends - aligner.b_size[tokens.b]
                last = int(tokens.a_ends[-1]) if len(tokens.a_ends) else 0
                for low in range(0, max(last, 1), range_bytes):
                    a = slice(*np.searchsorted(a_starts, [low, low + range_bytes]))
                    b = slice(*np.searchsorted(b_starts, [low, low + range_bytes]))
                    fragment, groups = Fragment.of(
                        list(zip(tokens.a[a].tolist(), (tokens.a_ends[a] + start).tolist())),
                        list(zip(tokens.b[b].tolist(), (tokens.b_ends[b] + start).tolist())),
                    )
                    row = (uid, key, start + low, len(groups), ";".join(groups), *sums, rest, *_fragment_row(fragment))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
                    sums, rest = (0, 0, 0, 0, 0, False), []

    return pieces.mapInArrow(build, schema)


def _fragment_row(f: Fragment) -> tuple:
    return _flat(f.prefix_a), _flat(f.prefix_b), f.closed, _flat(f.suffix_a), _flat(f.suffix_b), [
        {"at": at, "n": n, "text": text} for at, n, text in f.joints
    ]


def _fragment_from(row: tuple) -> Fragment:
    pairs = lambda flat: list(zip(flat[::2], flat[1::2]))
    return Fragment(pairs(row[0]), pairs(row[1]), row[2], pairs(row[3]), pairs(row[4]), [(j["at"], j["n"], j["text"]) for j in row[5]])


def _compose(fragments: DataFrame, stretch: int) -> DataFrame:
    """Fragments of one document whose numbers fall into the same stretch become one."""
    names = ["uid", "seq", *(f.split()[0] for f in _FRAGMENT.replace("at:long,n:int,text:string", "").split(", "))]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            row = (now[0], first, *_fragment_row(whole))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int64(), *_FRAGMENT_TYPES])], names=names)

        now, first, whole = None, 0, Fragment()
        for batch in batches:
            for uid, seq, group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (uid, group) != now:
                    if now is not None:
                        yield out()
                    now, first, whole = (uid, group), seq, _fragment_from(row)
                else:
                    whole = whole.then(_fragment_from(row), seq)
        if now is not None:
            yield out()

    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.floor(F.col("seq") / stretch).cast("bigint")
    dealt = fragments.select("uid", "seq", group.alias("stretch"), *names[2:]).repartition(parts, "uid", "stretch")
    return dealt.sortWithinPartitions("uid", "stretch", "seq").mapInArrow(compose, f"uid long, seq long, {_FRAGMENT}")


def _digests(texts: DataFrame) -> DataFrame:
    """``uid, n_groups, groups_sha256`` from rows uid, place, n, text. A digest is sequential: one document is one task, read as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([total], pa.int64()), pa.array([state.hexdigest()])], names=["uid", "n_groups", "groups_sha256"]
        )
        now, total, state = None, 0, hashlib.sha256()
        for batch in batches:
            for uid, n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if uid != now:
                    if now is not None:
                        yield row()
                    now, total, state = uid, 0, hashlib.sha256()
                if n:
                    state.update((";" if total else "").encode() + text.encode())
                    total += n
        if now is not None:
            yield row()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("uid", "place", "n", "text").repartition(parts, "uid").sortWithinPartitions("uid", "place")
    return dealt.mapInArrow(digest, "uid long, n_groups long, groups_sha256 string")


def _long_documents(pieces: DataFrame, a_path: str, b_path: str, counts, range_bytes: int, fan_in: int) -> DataFrame:
    """Result rows of long documents, composed from their fragments."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What composition closed, and the group the document begins with."""
        for batch in batches:
            for uid, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                whole = _fragment_from(row)
                a, b = [str(i) for i, _ in whole.prefix_a], [str(i) for i, _ in whole.prefix_b]
                rows = [(2 * at, n, text) for at, n, text in whole.joints]
                if whole.closed:
                    rows.append((-1, 1, rendered(a, [0, len(a)], b, [0, len(b)])[0]))
                if rows:
                    place, n, text = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string())],
                        names=["uid", "place", "n", "text"],
                    )

    parts = stored(_fragments(pieces, a_path, b_path, counts, range_bytes), "alignment-fragments")
    farthest = parts.agg(F.max("seq")).first()[0]
    names = [f.split()[0] for f in _FRAGMENT.replace("at:long,n:int,text:string", "").split(", ")]
    whole, stretch = parts.select("uid", "seq", *names), range_bytes
    while farthest is not None and stretch <= farthest:
        stretch *= fan_in
        whole = _compose(whole, stretch)
    texts = whole.mapInArrow(finish, "uid long, place long, n int, text string").unionByName(
        parts.where("groups > 0").select("uid", (2 * F.col("seq") + 1).alias("place"), F.col("groups").alias("n"), "text")
    )
    added = parts.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")],
        F.max("unspelled").alias("unspelled"), F.flatten(F.collect_list(F.when(F.size("rest") > 0, F.col("rest")))).alias("rest"),
    )
    fine = ~F.col("unspelled")
    zero = lambda c: F.when(fine, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return added.join(_digests(texts), "uid", "left").select(
        "uid", "doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
        F.when(fine, F.col("groups_sha256")).otherwise("").alias("groups_sha256"),
        F.when(fine, F.col("rest")).otherwise(F.array().cast(_REST)).alias("rest"),
    )


def alignments(
    docs: DataFrame, a_path: str, b_path: str, long_bytes: int = LONG_BYTES, range_bytes: int = RANGE_BYTES,
    fan_in: int = FAN_IN, sent_pairs: int = SENT_PAIRS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not used): how the tokenizers' tokens align.

    A byte-level vocabulary (``a_path``) encodes a blank and the text, a piece vocabulary (``b_path``) the same bytes. ``n_groups`` counts the
    stretches between places where both sides end a token, ``n_links`` the pairs of overlapping tokens. A pair's count
    is the number of links of all documents that hold it; ``count_sum`` adds it over a document's links and
    ``n_best`` counts the links whose count is the highest of their b id, ties included. Null and empty texts,
    and texts that one side does not spell byte for byte, have zeros and an empty digest and no links.
    Repeated rows count each.

    Counts of the ``sent_pairs`` most frequent pairs go to the workers; links of other pairs are joined to theirs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.octet_length("text") <= long_bytes)
    cut = _cut_long(rows.where(F.octet_length("text") > long_bytes), long_bytes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(cut.repartition(parts, "uid", "start"), "alignment-pieces")
    # a document that is not spelled is not counted, whichever of its pieces shows it
    unspelled = pieces.where(F.contains("text", F.lit("▁"))).select("uid").distinct()
    counted = short.select("text").unionByName(pieces.join(unspelled, "uid", "left_anti").select("text"))
    pairs = stored(count_links(counted, a_path, b_path), "alignment-pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("highest"))
    rated = stored(
        pairs.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "alignment-rated"
    )
    partial = rated.count() > sent_pairs
    sent = (rated.orderBy(F.desc("n"), "pair").limit(sent_pairs) if partial else rated).toArrow()
    counts = spark.sparkContext.broadcast(PairCounts(*(sent.column(c).to_numpy() for c in ("pair", "n", "best"))))
    whole = _whole_documents(short, a_path, b_path, counts).unionByName(_long_documents(pieces, a_path, b_path, counts, range_bytes, fan_in))
    if not partial:
        return whole.drop("uid", "rest")
    whole = stored(whole, "alignment-rows")
    left = whole.select("uid", F.explode("rest").alias("r")).select("uid", "r.pair", "r.m")
    more = left.join(rated, "pair").groupBy("uid").agg(
        F.sum(F.col("m") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best")
    )
    return whole.join(more, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


@llm_query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary over every whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
