"""Token ids of whole texts, equal to the tokenizers library's, with a bounded memory of runs already encoded.

Both vocabularies split a text into pieces before merging, and merges never cross a piece. A run of characters between
blanks therefore always gets the same ids, so each distinct run of a batch goes through the library once and Arrow's
dictionary kernels spread the ids over its occurrences. Texts with anything that could make the split depend on more
than the run (rare characters, repeated blanks, special-token marks) go through the library whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import kept

# Tasks already fill the cores; the library's own threads would only add memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters whose class (letter, digit, blank, other) is the same in every Unicode version; others go the whole-text way.
_ODD = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bd}]|<\|"
#: In these the byte-level vocabulary's blanks do not simply lead the next run.
_BLANKS = r"|  | \n|\n | $|^ |\n\n|[\t\r]|\n$"
#: Bytes of text handled at once.
SLICE = 4 << 20
#: New runs handed to the library at once: what it returns is large.
LOT = 1024


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a text column of about ``most`` bytes, with the row each starts at; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, texts.slice(at, end - at)
        at = end


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit words; a null text has none."""

    def __init__(self, path: str, bound: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str().replace('": ', '":')
        self.known: dict[str, bytes] = {}
        self.bound = bound

    def whole(self, text: str | None) -> bytes:
        """The library's ids of one text, with nothing remembered."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], "<u4").tobytes()

    def _of_runs(self, runs: list[str]) -> list[bytes]:
        known = self.known
        new = [x for x in runs if x not in known]
        now = {}
        for at in range(0, len(new), LOT):
            lot = new[at : at + LOT]
            # Frequent runs come early, so what is known first is kept and rare later runs are not.
            to = known if len(known) < self.bound else now
            for x, e in zip(lot, self.tokenizer.encode_batch_fast(lot, add_special_tokens=False), strict=True):
                to[x] = struct.pack(f"<{len(e)}I", *e.ids)
        return [known[x] if x in known else now[x] for x in runs]

    def _plain(self, texts: pa.Array) -> list[memoryview]:
        if self.by_word:
            # The vocabulary drops blanks and case, so both go before runs are told apart.
            runs = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-z])([,.;:!?])", r"\1 \2"))
        else:
            # A mark before each blank, line break and closing punctuation: the library parts pieces there too.
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\1 "), "\n", "\1\n")
            runs = pc.split_pattern(pc.replace_substring_regex(texts, r"([A-Za-z])([,.;:!?])", "\\1\1\\2"), "\1")
        coded = runs.flatten().dictionary_encode()
        ids = pa.array(self._of_runs(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        first = runs.offsets.to_numpy()
        ends = ends[first - first[0]]
        data = memoryview(ids.buffers()[2]) if len(ids) and ids.buffers()[2] else memoryview(b"")
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes | memoryview]:
        """Ids of each text of a column; call it on ``slices`` of long columns."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return []
        whole = pc.match_substring_regex(texts, _ODD + ("" if self.by_word else _BLANKS))
        plain = texts.filter(pc.invert(whole))
        easy = iter(self._plain(plain) if len(plain) else [])
        return [self.whole(texts[i].as_py()) if w else next(easy) for i, w in enumerate(whole.to_pylist())]


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return kept(f"encoder {path}", lambda: Encoder(path))
