"""Token ids of texts by a tokenizer that drops white space, with a cache of what lies between it.

A text is cut at blanks and line feeds, and after a run of Latin letters that one of a few ASCII signs follows; the
tokenizer never joins anything across these places, so ids of the parts are those of the whole. Texts with other
white space go through the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np

from pricecast.llm.token_store import OTHER_SPACE, Numbered

# Without the dotted capital I (U+0130), whose lower case ends in a mark that is not a letter.
PART = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[,.!?;:#$%&*|])|[^ \\n]+")
MARK = re.compile("[\u0300-\u036f]")
REMEMBERED = 500_000

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts; one per worker process and tokenizer file. It remembers a bounded number of parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.start_over()

    @staticmethod
    def at(path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def start_over(self) -> None:
        self.numbers = Numbered()
        self.uses = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        """Of each known part in ``ids``, and the end."""
        self.ids = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Make room; of what is known, the parts used most often stay."""
        parts, uses, starts, ids = list(self.numbers), self.uses, self.starts, self.ids
        stay = np.sort(np.argsort(-uses, kind="stable")[: REMEMBERED // 2])
        stay = stay[uses[stay] > 1]
        self.start_over()
        for i in stay.tolist():
            self.numbers[parts[i]]
        sizes = starts[stay + 1] - starts[stay]
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.ids = gathered(ids, starts[stay], sizes)
        self.uses = np.zeros(len(stay), np.int64)

    def learn(self) -> None:
        """Encode the parts that have a number but no ids yet."""
        new = list(islice(self.numbers, len(self.starts) - 1, None))
        if not new:
            return
        # Many parts in one call, with a bar between them: it is a token of its own, and no other text gives its id.
        barred = [i for i, part in enumerate(new) if "|" in part]
        plain = [part for part in new if "|" not in part] if barred else new
        joined = [" | ".join(plain[at : at + 256]) for at in range(0, len(plain), 256)]
        flat = np.fromiter(chain.from_iterable([*e.ids, self.bar] for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(flat == self.bar)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = flat[flat != self.bar]
        if len(sizes) != len(plain):
            raise ValueError("a part does not end at its bar")
        if barred:
            own = [self.tokenizer.encode(new[i], add_special_tokens=False).ids for i in barred]
            at = np.array(barred) - np.arange(len(barred))
            flat = np.insert(flat, np.repeat(np.r_[0, np.cumsum(sizes)][at], [len(o) for o in own]), [i for o in own for i in o])
            sizes = np.insert(sizes, at, [len(o) for o in own])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        known = self.numbers.__getitem__
        own = [None if OTHER_SPACE.search(t) else [*map(known, PART.findall(lowered(t)))] for t in texts]
        self.learn()
        at = np.fromiter(chain.from_iterable(o for o in own if o), np.int64)
        seen = np.bincount(at, minlength=len(self.numbers))
        seen[: len(self.uses)] += self.uses
        self.uses = seen
        sizes = self.starts[at + 1] - self.starts[at]
        flat, ends = gathered(self.ids, self.starts[at], sizes), np.r_[0, np.cumsum(sizes)]
        out, done = [], 0
        for t, numbers in zip(texts, own, strict=True):
            if numbers is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            out.append(flat[ends[done] : ends[done + len(numbers)]])
            done += len(numbers)
        return out


def lowered(text: str) -> str:
    """ASCII capitals in lower case, as the tokenizer has them anyway: fewer different parts.

    Not before marks that may join them: some pairs of letter and mark are one character in lower case only.
    """
    return text if MARK.search(text) else text.encode().lower().decode()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]
