"""Token ids by the tokenizers library, each distinct word of a batch encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JOINED = 1000
# Words whose ids a task keeps for its next chunks.
REMEMBERED = 300_000
CHUNK_BYTES = 8 << 20
# ASCII marks other than the apostrophe, which may begin a piece of letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TRAILING = r"(?P<marks>[!-&(-/:-@\[-`{-~]+)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def laid(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of a pool that begin at `starts`, laid end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


class WordEncoder:
    """Whole texts to ids, for tokenizers that drop white space and mark word ends.

    Such a tokenizer gives the ids of a text's space-separated words in turn, so each
    distinct word of a batch is encoded once and its ids are laid out again with NumPy.
    ASCII letters are lowered before, as the tokenizer lowers them too; texts that may
    hold a special token are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Whether letters and the marks after them are two pieces.
        pairs = self._lists([letter + mark for letter in "aé" for mark in MARKS])
        self.parts_marks = all(self.ends[x].sum() == 2 and self.ends[x[-1]] for x in pairs)
        # Remembered words; ids of all of them, where each word's begin, how many it has.
        self.names = pa.array([], pa.large_string())
        self.pool, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lists(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, starts and counts of words that are one piece each: many at a time, parted
        at the pieces' ends."""
        order, counts, flats, rest = [], [], [], [np.zeros(0, np.int64)]
        groups = [np.arange(i, min(i + JOINED, len(words))) for i in range(0, len(words), JOINED)]
        lines = [" ".join(words.slice(i, JOINED).to_pylist()) for i in range(0, len(words), JOINED)]
        for group, flat in zip(groups, self._lists(lines)):
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(flat):  # not so with this tokenizer
                rest.append(group)
                continue
            order.append(group)
            counts.append(np.diff(cuts, prepend=0))
            flats.append(flat)
        order = np.concatenate([*order, *rest])
        alone = self._lists(words.take(pa.array(np.concatenate(rest))).to_pylist())
        counts = np.concatenate([*counts, np.array([len(x) for x in alone], np.int64)])
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at[order], size[order] = np.cumsum(counts) - counts, counts
        return np.concatenate([np.zeros(0, np.uint32), *flats, *alone]), at, size

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, starts and counts of words that are not remembered. Letters are one piece
        to such a tokenizer, and marks after them another, so each distinct run of letters
        and of marks is encoded once, and words are put together from the two."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        marked = pc.less(pc.binary_length(stems), pc.binary_length(words))
        # Letters that the tokenizer's normal form or lower case splits take marks to themselves.
        plain = pc.utf8_is_alpha(stems)
        wide = pc.not_equal(pc.binary_length(stems), pc.cast(pc.utf8_length(stems), pa.int64()))
        some = stems.filter(wide)
        stable = pc.and_(pc.utf8_is_alpha(pc.utf8_normalize(some, "NFC")), pc.invert(pc.match_substring(some, "\u0130")))
        plain = pc.and_(plain, pc.replace_with_mask(pa.repeat(True, len(stems)), wide, stable))
        plain = plain if self.parts_marks else pc.and_(plain, pc.invert(marked))
        marked = pc.and_(plain, marked)
        marks = pc.extract_regex(words.filter(marked), TRAILING).field("marks")
        parts = pa.concat_arrays([stems.filter(plain), marks]).dictionary_encode()
        pool, at, size = self._pieces(parts.dictionary)
        codes = parts.indices.to_numpy()
        whole = self._lists(words.filter(pc.invert(plain)).to_pylist())
        plain, marked = (x.to_numpy(zero_copy_only=False) for x in (plain, marked))
        # Two places a word: of the letters, or of the whole word, and of the marks.
        starts, counts = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        letters = np.count_nonzero(plain)
        for mask, place, own in ((plain, 0, codes[:letters]), (marked, 1, codes[letters:])):
            starts[mask, place], counts[mask, place] = at[own], size[own]
        counts[~plain, 0] = sizes = np.array([len(x) for x in whole], np.int64)
        starts[~plain, 0] = len(pool) + np.cumsum(sizes) - sizes
        pool = laid(np.concatenate([pool, *whole]), starts.ravel(), counts.ravel())
        counts = counts.sum(axis=1)
        return pool, np.cumsum(counts) - counts, counts

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, starts and counts of distinct words. When the memory is full, it begins
        again with the words at hand, among which are the frequent ones."""
        found = pc.index_in(words, value_set=self.names)
        unknown = pc.is_null(found)
        new = words.filter(unknown)
        pool, at, size = self._new(new)
        at = at + len(self.pool)
        pool, starts, counts = np.concatenate([self.pool, pool]), np.concatenate([self.starts, at]), np.concatenate([self.counts, size])
        codes = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes[unknown.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
        names = pa.concat_arrays([self.names, new])
        keep = np.arange(len(names)) if len(names) <= REMEMBERED else codes[:REMEMBERED]
        keep = keep[pc.less(pc.binary_length(names.take(pa.array(keep))), 64).to_numpy(zero_copy_only=False)]
        self.names, self.counts = names.take(pa.array(keep)), counts[keep]
        self.pool, self.starts = laid(pool, starts[keep], self.counts), np.cumsum(self.counts) - self.counts
        return pool, starts[codes], counts[codes]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, end to end, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten().dictionary_encode()
        pool, starts, counts = self._words(words.dictionary)
        codes = words.indices.to_numpy(zero_copy_only=False)
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.cumsum(per_text)]
        return laid(pool, starts[codes], counts[codes]), np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the offsets of each text; null is empty."""
        # A copy: a slice that is cast keeps offsets which the string kernels misread.
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())
        special = pc.match_substring(texts, "<|")
        if not pc.any(special).as_py():
            flat, sizes = self._plain(texts)
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        flat, own = self._plain(texts.filter(pc.invert(special)))
        lists = self._lists(texts.filter(special).to_pylist())
        mask = special.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        sizes[~mask], sizes[mask] = own, [len(x) for x in lists]
        each = np.concatenate([own, sizes[mask]])
        starts = np.zeros(len(texts), np.int64)
        starts[np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])] = np.cumsum(each) - each
        return laid(np.concatenate([flat, *lists]), starts, sizes), np.concatenate([[0], np.cumsum(sizes)])


# White characters of ASCII and beyond, inside the brackets of a pattern.
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class SpacedEncoder(WordEncoder):
    """Whole texts to ids, for byte-level tokenizers whose pieces hold a space only in
    front: a piece begins at every space that has a mark or letter behind it, so a text is
    cut there and each distinct part, its space included, is encoded once. Texts that may
    hold a special token are encoded as they are.
    """

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.breaks = np.zeros(len(self.begins), bool)
        self.breaks[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool, starts and counts of parts that are not remembered. Parts with one space,
        in front, are encoded many at a time and parted where a space begins, parts
        without white between line breaks, and others one by one."""
        spaced = pc.match_substring_regex(words, f"^ [^{WHITE}](?s:[^ ]*[^{WHITE}])?$").to_numpy(zero_copy_only=False)
        bare = pc.match_substring_regex(words, f"^[^{WHITE}]+$").to_numpy(zero_copy_only=False)
        rest, order, counts, flats = [np.flatnonzero(~spaced & ~bare)], [], [], []
        for mask, glue, first in ((spaced, "", self.begins), (bare, "\n", self.breaks)):
            plain = np.flatnonzero(mask)
            groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
            lines = ["".join(glue + w for w in words.take(pa.array(g)).to_pylist()) for g in groups]
            for group, flat in zip(groups, self._lists(lines)):
                starts = np.flatnonzero(first[flat])
                if len(starts) != len(group):  # not so with this tokenizer
                    rest.append(group)
                    continue
                order.append(group)
                counts.append(np.diff(np.append(starts, len(flat))) - len(glue))
                flats.append(flat[~first[flat]] if glue else flat)
        order += rest
        alone = self._lists(words.take(pa.array(np.concatenate(rest))).to_pylist())
        counts = np.concatenate([*counts, np.array([len(x) for x in alone], np.int64)])
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.concatenate(order)
        at[order], size[order] = np.cumsum(counts) - counts, counts
        return np.concatenate([np.zeros(0, np.uint32), *flats, *alone]), at, size

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, end to end, and how many each text has."""
        mark = "\x00"
        if pc.any(pc.match_substring(texts, mark)).as_py():
            return self._whole(texts)
        if pc.any(pc.match_substring_regex(texts, f"[{WHITE}]{{2}}")).as_py():
            held = pc.replace_substring_regex(texts, r" ([\x21-\x7e]|\p{L})", mark + r" \1")
        else:  # a lone line break is a piece of its own
            held = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", f"{mark}\n{mark}")
        split = pc.split_pattern(held, mark)
        words = split.flatten().dictionary_encode()
        pool, starts, counts = self._words(words.dictionary)
        codes = words.indices.to_numpy(zero_copy_only=False)
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[codes])])[np.cumsum(per_text)]
        return laid(pool, starts[codes], counts[codes]), np.diff(ends, prepend=0)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._lists(texts.to_pylist())
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.array([len(x) for x in lists], np.int64)
