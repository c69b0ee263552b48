"""A trie of names, walked once over the words of a text.

Offsets count characters from 0 and the end is exclusive. A name is found where its words stand with the
gaps it is written with, in lower case; at each word the longest name is taken, from left to right,
without overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

SPAN_TYPE = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("entity_id", pa.string()), ("entity_name", pa.string())]
)
PIECE_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
# Rows whose spans are Python objects at one time.
_ROWS = 256
WORD = r"[\p{L}\p{M}\p{N}]+"


class NameTrie:
    """Names by their words. The first step is a word, every further one a gap and a word.

    What travels to the workers are the names; each worker builds the trie once.
    """

    def __init__(self, names: Iterable[tuple[str, str | None, str | None]]):
        self.names = list(names)

    def __getstate__(self):
        return {"names": self.names}

    def _build(self) -> None:
        import regex

        self.words = regex.compile(WORD).finditer
        self.root: dict[str, list] = {}
        for surface, *entity in self.names:
            steps, last, node = self.root, 0, None
            for m in self.words(surface):
                node = steps.setdefault(surface[last : m.end()], [None, {}])
                steps, last = node[1], m.end()
            if node is not None and last == len(surface) and node[0] is None:
                node[0] = tuple(entity)

    def find(self, text: str, lower: str) -> Iterator[tuple[int, int, tuple]]:
        """Start, end and entity of each name; ``lower`` is the text in lower case."""
        if not hasattr(self, "root"):
            self._build()
        words = [m.span() for m in self.words(lower)]
        # a letter may become longer in lower case; words then have other places in the text itself
        places = words if len(lower) == len(text) else [m.span() for m in self.words(text)]
        free, root = 0, self.root
        for i, (start, end) in enumerate(words):
            if i < free:
                continue
            node, j, best = root.get(lower[start:end]), i, None
            while node is not None:
                if node[0] is not None:
                    best = (j, node[0])
                if not node[1] or j + 1 == len(words):
                    break
                node = node[1].get(lower[words[j][1] : words[j + 1][1]])
                j += 1
            if best is not None:
                yield places[i][0], places[best[0]][1], best[1]
                free = best[0] + 1

    def phrases(self, lower: str, lengths: list[int]) -> set[str]:
        """Distinct phrases of so many words."""
        if not hasattr(self, "root"):
            self._build()
        words = [m.span() for m in self.words(lower)]
        return {lower[words[i][0] : words[i + n - 1][1]] for n in lengths for i in range(len(words) - n + 1)}


def _lists(ends: list[int], row_ends: list[int], columns: list[pa.Array], kind: pa.StructType) -> pa.Array:
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
    return pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), found)


def _spans(texts: pa.Array, lowers: pa.Array, tries: Iterator[NameTrie]) -> pa.Array:
    starts, ends, found, ids, names = [], [], [], [], []
    text_ends, row_ends = [0], [0]
    for row, lower_row, trie in zip(texts.to_pylist(), lowers.to_pylist(), tries):
        for text, lower in zip(row or (), lower_row or ()):
            if text:
                for start, end, (entity_id, entity_name) in trie.find(text, lower):
                    starts.append(start)
                    ends.append(end)
                    found.append(text[start:end])
                    ids.append(entity_id)
                    names.append(entity_name)
            text_ends.append(len(starts))
        row_ends.append(len(text_ends) - 1)
    return _lists(text_ends, row_ends, [pa.array(c, f.type) for c, f in zip((starts, ends, found, ids, names), SPAN_TYPE)], SPAN_TYPE)


def _pieces(texts: pa.Array, lowers: pa.Array, tries: Iterator[NameTrie], carried: bool) -> pa.Array:
    links, found, starts, ends, ids, names = [], [], [], [], [], []
    text_ends, row_ends = [0], [0]

    def add(link: int, text: str, start: int, end: int, entity: tuple = (None, None)) -> None:
        links.append(link)
        found.append(text[start:end])
        starts.append(start)
        ends.append(end)
        if carried:
            ids.append(entity[0])
            names.append(entity[1])

    for row, lower_row, trie in zip(texts.to_pylist(), lowers.to_pylist(), tries):
        for text, lower in zip(row or (), lower_row or ()):
            if text:
                last = 0
                for start, end, entity in trie.find(text, lower):
                    if start > last:
                        add(0, text, last, start)
                    if end > start:
                        add(1, text, start, end, entity)
                    last = end
                if last < len(text):
                    add(0, text, last, len(text))
            text_ends.append(len(links))
        row_ends.append(len(text_ends) - 1)
    kind = pa.struct([*PIECE_TYPE, *list(SPAN_TYPE)[3:]]) if carried else PIECE_TYPE
    kinds = pa.array(["text", "link"]).take(pa.array(links, pa.int32()))
    rest = [pa.array(c, f.type) for c, f in zip((found, starts, ends, ids, names), list(kind)[1:])]
    return _lists(text_ends, row_ends, [kinds, *rest], kind)


def _by_slices(find, texts: pa.Array, lowers: pa.Array, tries: Iterable[NameTrie]) -> pa.Array:
    """``find`` over few rows at a time, so that the Python objects of a whole batch never live at once."""
    tries = iter(tries)
    starts = range(0, max(len(texts), 1), _ROWS)
    return pa.concat_arrays([find(texts.slice(at, _ROWS), lowers.slice(at, _ROWS), tries) for at in starts])


def spans_in_lists(texts: pa.Array, lowers: pa.Array, tries: Iterable[NameTrie]) -> pa.Array:
    """For each row's list of texts the spans in each, by the row's trie; null texts and lists have none."""
    return _by_slices(_spans, texts, lowers, tries)


def pieces_in_lists(texts: pa.Array, lowers: pa.Array, tries: Iterable[NameTrie], carried: bool = False) -> pa.Array:
    """For each row's list of texts the text and link pieces of each, which put together are the text again.

    Empty pieces are left out; with ``carried`` a link piece takes over the entity of its span.
    """
    return _by_slices(lambda t, l, tries: _pieces(t, l, tries, carried), texts, lowers, tries)
