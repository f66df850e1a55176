"""Tokenizing whole texts with the tokenizers library, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from lectern.functions.bpe import byte_characters
from lectern.llm.common import kept


#: Stands for a line break before a word while a text is cut; a text that holds it is encoded whole.
BREAK = "\x00"
#: White space after a line break that may be one pre-token with it.
SPACE_AFTER_BREAK = re.compile(r"\n\s(?:\s|\Z)")
#: A run of these after a letter or digit is a pre-token of its own. An apostrophe is not among them: it may begin one.
MARKS = '.,;:!?"()[]{}#$%&*+-/<=>@\\^_`|~'
#: Letters below this are not changed by normal forms, and lower-case to letters, one for one.
PLAIN = "\u0130"


class Words(dict):
    """Ids of words, as the bytes of 32-bit integers; a missing word is encoded when it is first asked for.

    A word stands for ``prefix`` and itself. One that must not be cut off from what follows has None.
    """

    def __init__(self, owner: WordCache, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix
        self.lead = prefix.translate(owner.bytes)

    def __missing__(self, word: str) -> bytes | None:
        owner = self.owner
        if word.isalpha():
            if owner.lower:
                ids = owner.letters(word.lower()) if max(word) < PLAIN else owner.plain(word)
            else:
                ids = owner.letters(word, self.lead)
        elif word[:1] == BREAK and not owner.lower:
            ids = owner.line_break + owner.first[word[1:]] if len(word) > 1 else owner.line_break
        else:
            kept = word.rstrip(MARKS)
            # lower-casing may end in a mark, which would belong to one run with those that follow
            if len(kept) < len(word) and kept and (kept[-1].lower()[-1:].isalpha() or "0" <= kept[-1] <= "9"):
                head = self[kept]
                ids = None if head is None else head + owner.run(word[len(kept) :])
            elif owner.lower or not word[-1:].isspace() and (word or not self.prefix):
                ids = owner.plain(self.prefix + word)
            else:
                ids = None
        self[word] = ids
        return ids


class WordCache:
    """Encodes texts with a tokenizer file; each distinct word is encoded once.

    A text is cut at single spaces, where both kinds of vocabulary start a new pre-token, and the words' ids are
    joined; the result equals encoding the text as a whole. For a byte-level vocabulary (``lower`` false) a word has
    the space before it, and is cut at line breaks too; white space before a space may belong to one pre-token with it,
    so texts with words that end in white space or with two white spaces after a line break are encoded whole. A vocabulary that
    drops white space (``lower`` true) may be cut anywhere in it. A word of letters alone is one pre-token and goes
    straight to the tokenizer's model. A null text has no ids.

    A text that may hold the string of a special token is encoded whole, as the library does it: by its default the
    string becomes the special id. With ``special_as_text`` it is ordinary text.
    """

    #: Words kept; beyond them the cache starts afresh.
    MOST = 800_000

    def __init__(self, path: str, lower: bool = False, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.lower, self.most_id = lower, max(self.tokenizer.get_vocab().values())
        self.special = [] if special_as_text else sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.signs = sorted({c[:2] for c in self.special})
        self.bytes = str.maketrans({chr(b): c for c, b in byte_characters().items()})
        self.runs: dict[str, bytes] = {}
        self.line_break = b"" if lower else self.plain("\n")
        self.first, self.known = Words(self, ""), Words(self, "" if lower else " ")

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def run(self, marks: str) -> bytes:
        if marks not in self.runs:
            if len(self.runs) > self.MOST:
                self.runs.clear()
            self.runs[marks] = self.plain(marks)
        return self.runs[marks]

    def letters(self, word: str, lead: str = "") -> bytes:
        """The ids of a pre-token of letters, with a space before it if it has one."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def uncut(self, text: str) -> bool:
        """Whether a text must be encoded whole, by what its words do not show."""
        if any(s in text for s in self.signs) and any(s in text.lower() for s in self.special):
            return True
        return not self.lower and (BREAK in text or SPACE_AFTER_BREAK.search(text) is not None)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Each text's ids, and ``end_id`` after them if given."""
        if len(self.known) + len(self.first) > self.MOST:
            self.known.clear()
            self.first.clear()
        get, out = self.known.__getitem__, []
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        line = " " if self.lower else " " + BREAK
        for text in texts:
            text = text or ""
            words = [] if self.uncut(text) else text.replace("\n", line).split(" ")
            try:
                ids = np.frombuffer(b"".join([self.first[words[0]], *map(get, words[1:]), end]), dtype=np.uint32)
            except (IndexError, TypeError):  # a text, or a word in it, that must not be cut
                ids = np.append(self.whole(text), np.frombuffer(end, dtype=np.uint32))
            out.append(ids)
        return out


def word_cache(path: str, lower: bool = False, special_as_text: bool = False) -> WordCache:
    """The process's cache for a tokenizer file; a Python worker keeps it from task to task."""
    key, made = (path, lower, special_as_text), kept("words")
    if key not in made:
        made[key] = WordCache(*key)
    return made[key]
