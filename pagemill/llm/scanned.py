"""Text of scanned pages as continuous readable paragraphs.

The lines of a page are labelled as running matter, page number, body or break by a
linear chain model: weights for features of layout and text, weights for pairs of
neighbouring labels, and the best sequence by dynamic programming. The weights are
fitted (averaged perceptron) on a bounded sample of pages whose lines are sure: a line
alone at a page's edge, a heading, a line of the body that is no running line, and a
running line or the page's number as it stands, also put into a body. Boxes, pages and
types are hidden in part of the sample, so that the other features get their weight.
What the labels leave as body is mended - words divided at line ends are joined, words
with misrecognised characters replaced by the frequent word that they stand for - and
put together into paragraphs, also across elements and pages.

Statistics come from all rows: the running lines and the page number's offset of each
package, and the counts of words. Elements are then worked on in reading order, in
blocks of ``BLOCK`` elements of a package, so a very large package is spread over many
tasks; what passes from block to block (a sentence left open) is one row for a block,
and a block sees ``MARGIN`` elements beyond its ends, so that its labels are those of
the whole package. Frequent words are at hand in every task; a text that asks for the
count of any other form waits until the form has been looked up among all words, and is
mended then. The result does not depend on the size of the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.runtime import checkpoint

#: Elements of a package that one task works on at a time, and places beyond its ends that it sees.
BLOCK, MARGIN = 4096, 64
#: A running line is known within this many places and in the stretches next to it.
SPAN = 4096
#: Pairs of labels are corrected by this part of what features are, so that a line that is sure stays so.
PAIR_STEP = 0.1
#: Elements and least rounds by which the weights are fitted (few pages are gone over more often), and the longest text among them.
SAMPLE, ROUNDS, SAMPLE_TEXT = 1500, 4, 5000
#: Words with this share of all words are at hand in every task: at most its inverse in number.
VOCABULARY_SHARE = 3e-6
#: A word is misread if the word that it stands for is this many times as frequent.
MISREAD_RATIO = 8.0
#: The least count of a word that a misread one can stand for is this many times the ratio.
LEAST = 4.0
#: Words of two letters need this share of all words to stand for a misread one; words with this share are not searched for two confusions.
SHORT_SHARE = 6e-5
#: Longer strings are no words and are left as they are.
LONGEST_WORD = 64
#: Signs at the ends of a word that do not belong to it.
STRIP = ".,;:()[]{}<>\"'“”‘’„«»?…。，；：（）、·|"
HYPHENS = "-‐¬­"
#: Stands where a divided word may or may not keep its hyphen (a private character).
EITHER = "\ue0ff"

#: Characters as recognised and as printed (fixed values).
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("m", "in"), ("in", "m"), ("cl", "d"), ("d", "cl"), ("h", "li"), ("li", "h"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("!", "i"), ("!", "l"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("|", "i"),
    ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"), ("g", "q"), ("ä", "a"), ("ö", "o"), ("b", "h"), ("h", "b"),
    ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("$", "s"), ("@", "a"), ("€", "e"),
)

#: Where a line at a page's edge shows the page's number: alone, before or behind the running line; one of them at most matches.
PAGE_OF_LINE = (r"^\W*(?:[Pp]age\s+|S)?(\d{1,6})\W*$", r"^\s*(\d{1,6})\s+(?:·\s+)?\p{L}", r"\p{L}.*\s[·|]\s*(\d{1,6})\s*$")

LABELS = ("running", "number", "body", "break")
RUNNING, NUMBER, BODY, BREAK = range(4)
#: What is seen of a line.
FEATURES = (
    "any", "edge, alone", "edge, among lines", "middle, alone", "middle, among lines", "no box, alone", "no box, among lines", "number, alone", "number, alone, fits the page",
    "number, among lines, fits the page", "number, among lines, set off", "number, among lines, does not fit", "number, among lines, plain", "typed as number, no box",
    "running line", "running line, heading", "no running line", "typed as header, no box, short", "heading", "equation",
)
_AT = {name: i for i, name in enumerate(FEATURES)}

_NUMBER = re.compile(r"\s*(?:[-–—]\s*(?P<a>\w{1,10})\s*[-–—]|\[\s*(?P<b>\w{1,10})\s*\]|[Pp]age\s+(?P<c>\w{1,10})|(?P<d>\w{1,10})\s*\||\|\s*(?P<e>\w{1,10})|(?P<f>\w{1,10}))\s*\.?\s*")
_ARABIC = re.compile(r"[\dlIiOoSsZzB|]{1,6}")
_ROMAN = re.compile(r"(?i)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_DIGITS = str.maketrans("lIiOoSsZzB|", "11100552281")
_EQUATION = re.compile(r"\s*\(\s*\d+[a-z]?\s*\)\s*")
_LIST = re.compile(r"\s*\d+[.)]\s+\S")
_CLOSED = re.compile(r"[.!?。！？:：;；][\"'”’»)\]]*\s*$")
_SEEMING = re.compile(r"\b(?:Fig|Figs|Abb|Tab|Eq|No|Vol|Ref|vs|ca|cf)\.\s*$")
_MAY_BREAK = re.compile(r"[-‐]\s|[¬­]")
_BREAK = re.compile(r"(?<!\S)(\S*[^\W\d_])([-‐¬­])(\s+|(?<=[¬­])\s*)(?=[^\W\d_])(\S+)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: A page number that is set off, inside a text whose line ends are lost.
_INSIDE_NUMBER = re.compile(r"(?<=\S)\s+([-–—]\s*\w{1,10}\s*[-–—]|\[\s*\w{1,10}\s*\]|[Pp]age\s+\w{1,10}|\|\s*\w{1,10}|\w{1,10}\s*\|)\.?(?=\s+\S)")
#: One of these stands in a text that the expression above matches.
_SET_OFF = ("[", "|", "age", " -", " –", " —", "\n-", "\n–", "\n—")
_CITED = re.compile(r"\[\s*\d[\d\s,;–-]*\]")
_TOKEN = re.compile(r"\S+")
#: Ends of a key before a number that is not that of the page.
_VOLUME = re.compile(r"(?:,|\b(?:nos?|vol|nr|bd|issue|heft|part)\.?)$")


def page_number(line: str) -> tuple[int | None, bool] | None:
    """Value and whether it is set off (dashes, brackets, the word page) if a line is a page number; else None.

    Roman numbers have their value too, negative, as they are numbered apart.
    """
    m = _NUMBER.fullmatch(line)
    if not m:
        return None
    text = next(x for x in m.groups() if x)
    set_off = m["f"] is None
    if _ARABIC.fullmatch(text) and (any(c.isdigit() for c in text) or not set(text) - set("lIOSZB|")):
        return int(text.translate(_DIGITS)), set_off
    if text and _ROMAN.fullmatch(text):
        value, last = 0, 0
        for c in reversed(text.lower()):
            n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
            value += n if n >= last else -n
            last = max(last, n)
        return -value, set_off
    return None


def running_key(line: str) -> str:
    """A running line without its page number: lower case, digits as 9, one blank."""
    s = re.sub(r"\d+", "9", line.lower())
    s = re.sub(r"^\W*(?:page\s+)?[9lo]{1,3}\s*[·|.–—-]?\s+|\s+[·|–—-]?\s*[9lo]{1,3}\W*$", " ", " ".join(s.split()))
    return s.strip(" ·|–—-")


def same_line(key: str, keys: dict[int, list[str]]) -> bool:
    """Whether a line is one of the running lines, with a few characters misread."""
    n = len(key)
    if n < 6:
        return False
    slack = max(1, n // 12)
    for m in range(n - slack, n + slack + 1):
        for k in keys.get(m, ()):
            if k == key:
                return True
            if m == n and sum(a != b for a, b in zip(k, key)) <= max(2, n // 8):
                return True
            if k[:1] == key[:1] or k[-3:] == key[-3:] or k[3:6] == key[3:6]:
                if SequenceMatcher(None, k, key, autojunk=False).ratio() >= 0.86:
                    return True
    return False


def find_running(text: str, page: Page, expected: int | None) -> tuple[int, int] | None:
    """Where a running line, with its page number, stands inside a text whose line ends are lost.

    Stretches of words are compared as whole lines are, with digits folded and a few
    characters misread. As so few characters differ, one word of the line is as printed
    or keeps its beginning or end, and only stretches around such a word are compared.
    A line of less than three words or 15 characters may be ordinary words; it counts
    if it is written as a heading is (a single word: in capitals), beside the page's
    number, or, in a script without capitals, set off by blanks.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    words = [w if w.isalpha() else re.sub(r"\d+", "9", w) for w in (text[a:b].lower() for a, b in spans)]
    tried = set()
    for j, w in enumerate(words):
        for anchor in (w, w[:3] + "*", "*" + w[-3:]):
            for key, size, at in page.anchors.get(anchor, ()):
                for i in (j - at, j - at - 1, j - at + 1):
                    for n in (size, size - 1, size + 1):
                        if i < 0 or n < 1 or i + n > len(spans) or (i, n, key) in tried:
                            continue
                        tried.add((i, n, key))
                        a, b = spans[i][0], spans[i + n - 1][1]
                        line = " ".join(words[i : i + n])
                        if abs(len(line) - len(key)) > max(1, len(key) // 12) or b - a >= len(text) * 0.8 or not same_line(line, {len(key): [key]}):
                            continue
                        if _VOLUME.search(key) and i + n < len(spans) and words[i + n].strip(STRIP) == "9":
                            n += 1
                        number = [k for k in (i - 1, i + n) if 0 <= k < len(spans) and expected is not None and text[slice(*spans[k])] == str(expected)]
                        if len(key) < 15 or key.count(" ") < 2:
                            own = text[a:b].split()
                            heading = all(x[:1].isupper() for x in own if len(x) > 3) and (len(own) > 1 or (own[0].isupper() and len(own[0]) > 5))
                            if not number and not (_CJK.search(key) or heading and text[a:b].lower() != text[a:b]):
                                continue
                        where = [i, i + n - 1, *number]
                        return spans[min(where)][0], spans[max(where)][1]
    return None


class Model:
    """Weights of a linear chain: for each feature and label, for each pair of labels, and for the first label of a page."""

    def __init__(self, weights=None, after=None, first=None):
        self.weights = weights or [[0.0] * 4 for _ in FEATURES]
        self.after = after or [[0.0] * 4 for _ in range(4)]
        self.first = first or [0.0] * 4
        self.ready()

    def ready(self) -> None:
        """What the best label of a line must lead by so that no neighbour can change it."""
        spread = lambda rows: max(max(r) - min(r) for r in rows)
        before = max(spread(list(zip(*self.after))), spread(self.after), spread([self.first]))
        self.lead = 2 * before + 1e-3
        self.seen: dict[tuple[int, ...], tuple[float, ...]] = {}
        self.sure: dict[tuple[float, ...], int] = {}

    def scores(self, features: tuple[int, ...]) -> tuple[float, ...]:
        """Weights of the four labels; there are few different sets of features."""
        got = self.seen.get(features)
        if got is None:
            got = self.seen[features] = tuple(map(sum, zip(*[self.weights[f] for f in features])))
        return got

    def leading(self, scores: tuple[float, ...]) -> int:
        """The best label if no neighbour can change it, else -1."""
        got = self.sure.get(scores)
        if got is None:
            second, first = sorted(scores)[-2:]
            got = self.sure[scores] = scores.index(first) if first - second > self.lead else -1
        return got

    def labels(self, lines: list[tuple[int, ...]]) -> list[int]:
        return self.best([self.scores(f) for f in lines])

    def best(self, scores: list[tuple[float, ...]]) -> list[int]:
        """The sequence of labels with the highest sum of weights.

        Where each line's best label leads by more than the pairs can take, these are the sequence.
        """
        if not scores:
            return []
        top = [self.leading(s) for s in scores]
        if -1 not in top:
            return top
        best = [f + s for f, s in zip(self.first, scores[0])]
        back: list[list[int]] = []
        for s in scores[1:]:
            row, now = [], []
            for j in range(4):
                i = max(range(4), key=lambda i: best[i] + self.after[i][j])
                row.append(i)
                now.append(best[i] + self.after[i][j] + s[j])
            back.append(row)
            best = now
        out = [max(range(4), key=best.__getitem__)]
        for row in reversed(back):
            out.append(row[out[-1]])
        return out[::-1]

    @classmethod
    def fitted(cls, pages: list[list[tuple[tuple[int, ...], int]]]) -> "Model":
        """Averaged perceptron over pages of (features, label); the same pages in the same order give the same weights."""
        model, total, n = cls(), cls(), 0
        for _ in range(max(ROUNDS, min(60, 2000 // max(1, len(pages))))):
            for page in pages:
                model.lead = float("inf")
                model.seen.clear()
                model.sure.clear()
                got = model.labels([f for f, _ in page])
                want = [label for _, label in page]
                if got != want:
                    for labels, by in ((want, 1.0), (got, -1.0)):
                        before = None
                        for (features, _), label in zip(page, labels):
                            for f in features:
                                model.weights[f][label] += by
                                total.weights[f][label] += by * n
                            at = model.first if before is None else model.after[before]
                            sum_ = total.first if before is None else total.after[before]
                            at[label] += by * PAIR_STEP
                            sum_[label] += by * n * PAIR_STEP
                            before = label
                n += 1
        mean = lambda a, b: [x - y / max(1, n) for x, y in zip(a, b)]
        return cls([mean(a, b) for a, b in zip(model.weights, total.weights)], [mean(a, b) for a, b in zip(model.after, total.after)], mean(model.first, total.first))


class Words:
    """The vocabulary with counts, and what a rare word stands for.

    ``rare`` are the counts of the less frequent forms that the text at hand asks for.
    """

    def __init__(self, counts: dict[str, int], total: int):
        self.counts = counts
        self.short = max(MISREAD_RATIO * LEAST, SHORT_SHARE * total)
        self.rare: dict[str, int] = {}
        self.seen: dict[str, str | None] = {}
        #: Tokens as they stand in texts in which there is nothing to mend.
        self.clean: set[str] = set()

    def count(self, word: str) -> int:
        return self.counts.get(word) or self.rare.get(word, 0)

    def printed(self, word: str) -> str | None:
        """The frequent word that a misread ``word`` (lower case) stands for, or None."""
        if self.rare:
            return self._printed(word)
        if word not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = self._printed(word)
        return self.seen[word]

    def _printed(self, word: str) -> str | None:
        if not 2 <= len(word) <= LONGEST_WORD or _CJK.search(word) or not any(c.isalpha() for c in word):
            return None
        own = self.count(word)
        need = MISREAD_RATIO * max(LEAST, own)
        if len(word) == 2:
            need = max(need, self.short)
        best, top, level, done = None, need - 1e-9, [word], {word}
        for depth in (1, 2):
            step = []
            for w in level:
                for seen, true in CONFUSIONS:
                    at = w.find(seen)
                    while at >= 0:
                        x = w[:at] + true + w[at + len(seen) :]
                        if x not in done:
                            done.add(x)
                            step.append(x)
                            n = self.count(x)
                            if n > top and len(x) > 1 and not any(c.isdigit() for c in x):
                                best, top = x, n
                        at = w.find(seen, at + 1)
            if best is not None:
                return best
            level, top = step, 4 * need
            if own > self.short:
                break
        return None


def misread_forms(word: str, depth: int) -> set[str]:
    """What ``word`` can be recognised as with up to ``depth`` confusions: every form for which ``Words.printed`` tries it."""
    done, level = {word}, {word}
    for _ in range(depth):
        step = set()
        for w in level:
            for seen, true in CONFUSIONS:
                at = w.find(true)
                while at >= 0:
                    step.add(w[:at] + seen + w[at + len(true) :])
                    at = w.find(true, at + 1)
        level = step - done
        done |= level
    return done - {word}


def _strip(token: str) -> str:
    return token.strip(STRIP)


def _outcomes(word: str) -> list[str]:
    """A word with ``EITHER`` in it, once with and once without each hyphen."""
    out = [""]
    for i, part in enumerate(word.split(EITHER)):
        out = [x + sign + part for x in out for sign in (("", "-") if i else ("",))]
    return out


def asked(text: str, words: Words) -> set[str]:
    """The forms whose counts ``mend`` may ask for and that are not at hand, whatever it decides on the way."""
    forms: set[str] = set()

    def join(m: re.Match) -> str:
        for left in _outcomes(_strip(m[1]).lower()):
            for right in _outcomes(_strip(m[4]).lower()):
                forms.update((f"{left}-{right}", left + right))
                if "-" in right:
                    head = re.split(r"[-\s]", right, maxsplit=1)[0]
                    forms.update((f"{left}-{head}", left + head))
        return m[1] + EITHER + m[4]

    for _ in range(2):
        if ("-" in text or "‐" in text or "¬" in text or "\xad" in text) and _MAY_BREAK.search(text):
            text = _BREAK.sub(join, text)
    for t in text.split():
        if t in words.clean:
            continue
        for low in _outcomes(_strip(t).lower()):
            if low in words.counts:
                continue
            forms.add(low)
            if "-" in low:
                forms.add(low.replace("-", ""))
                forms.update(low.split("-"))
    return {f for f in forms if f not in words.counts and any(c.isalpha() for c in f)}


def mend(text: str, words: Words, from_word: bool, to_word: bool) -> tuple[str, bool, bool]:
    """Body text as one line: mended text, whether a word was divided, whether a word was misread.

    ``from_word``: the text begins within a word; ``to_word``: it ends within one.
    """
    hyphen = False

    def join(m: re.Match) -> str:
        nonlocal hyphen
        left, right = _strip(m[1]).lower(), _strip(m[4]).lower()
        head = re.split(r"[-\s]", right, maxsplit=1)[0] if "-" in right else right
        kept, joined = f"{left}-{right}", left + right
        if m[2] in "-‐":
            a, b = words.count(kept), words.count(joined)
            if "-" in right and not a and not b:
                a, b = words.count(f"{left}-{head}"), words.count(left + head)
            if a >= b and a > 0:
                return f"{m[1]}-{m[4]}"
            if not b and words.printed(kept) and not words.printed(joined):
                return f"{m[1]}-{m[4]}"
        hyphen = True
        return m[1] + m[4]

    for _ in range(2):  # a word can be divided twice
        if (("-" in text or "‐" in text or "¬" in text or "\xad" in text) and _MAY_BREAK.search(text)):
            text = _BREAK.sub(join, text)
    tokens = text.split()
    misread = False
    clean = words.clean
    if clean.issuperset(tokens):
        return " ".join(tokens), hyphen, misread
    if len(clean) > 500_000:
        clean.clear()
    for i, t in enumerate(tokens):
        if t in clean or (i == 0 and from_word) or (i == len(tokens) - 1 and to_word):
            continue
        w = _strip(t)
        low = w.lower()
        if "-" in low and low.replace("-", "") != low:
            whole = low.replace("-", "")
            # the line end is lost, the hyphen stayed
            n = words.count(whole)
            if n >= 5 and n >= MISREAD_RATIO * words.count(low) and low.count("-") == 1 and not any(words.count(p) > n for p in low.split("-")):
                hyphen = True
                tokens[i] = t.replace("-", "")
                continue
        true = words.printed(low) if low else None
        if true is not None:
            misread = True
            if w[:1].isupper():
                true = true[:1].upper() + true[1:]
            tokens[i] = t.replace(w, true.upper() if w.isupper() and len(w) > 1 else true)
        else:
            clean.add(t)
    return " ".join(tokens), hyphen, misread


class Page:
    """What is known of a package while its pages are read; the running lines are prepared when first asked for."""

    def __init__(self, lines: list[str], offset: int | None):
        self.offset, self._raw = offset, lines

    def __getattr__(self, name: str):
        if name.startswith("_") or "_raw" not in self.__dict__:
            raise AttributeError(name)
        self._prepare(self.__dict__.pop("_raw"))
        return self.__dict__[name]

    def _prepare(self, lines: list[str]) -> None:
        self.keys: dict[int, list[str]] = {}
        for k in dict.fromkeys(map(running_key, lines)):
            # the most frequent come first; a misread form of a line is that line
            if len(k) >= 6 and not same_line(k, self.keys):
                self.keys.setdefault(len(k), []).append(k)
        #: Lengths that a line can have that is one of the running lines, with its number.
        self.shortest, self.longest = min(self.keys, default=0) * 0.9 - 1, max(self.keys, default=-1) * 1.1 + 24
        #: Words of the running lines, whole and by their ends: the line, its number of words and the word's place.
        self.anchors: dict[str, list[tuple[str, int, int]]] = {}
        for k in (k for ks in self.keys.values() for k in ks):
            parts = k.split(" ")
            for i, w in enumerate(parts):
                for anchor in {w, *((w[:3] + "*", "*" + w[-3:]) if len(w) > 5 else ())}:
                    self.anchors.setdefault(anchor, []).append((k, len(parts), i))

    def features(self, line: str, zone: str, alone: bool, kind: str, level: bool, page: int | None, inner: bool = False) -> tuple[int, ...]:
        """What is seen of one line of an element, as places in ``FEATURES``.

        ``inner``: the line is short, and a full line of the element precedes and a
        line follows it, so it is not the end of a paragraph.
        """
        where = "edge" if zone in ("top", "bottom") else "middle" if zone == "middle" else "no box"
        seen = ["any", where + (", alone" if alone else ", among lines")]
        number = page_number(line) if len(line) < 24 else None
        if number is not None:
            value, set_off = number
            known = self.offset is not None and page is not None
            fits = known and value == page + self.offset
            if alone:
                seen.append("number, alone")
                if fits:
                    seen.append("number, alone, fits the page")
                if kind == "page_number" and where == "no box":
                    seen.append("typed as number, no box")
            elif fits:
                seen.append("number, among lines, fits the page")
            elif known:
                seen.append("number, among lines, does not fit")
            else:
                seen.append("number, among lines, set off" if set_off or inner else "number, among lines, plain")
        else:
            if self.shortest <= len(line) <= self.longest and same_line(running_key(line), self.keys):
                seen.append("running line, heading" if level else "running line")
            else:
                seen.append("no running line")
            if where == "no box" and len(line) < 80 and kind in ("header", "page_header", "footer", "page_footer"):
                seen.append("typed as header, no box, short")
        if level:
            seen.append("heading")
        elif kind == "equation" or (alone and _EQUATION.fullmatch(line)):
            seen.append("equation")
        return tuple([_AT[x] for x in seen])


def bbox_zone(box: list[float] | None) -> str:
    """Where an element stands on its page: top, bottom, middle, or none if that is not known."""
    if not box or len(box) != 4 or any(x is None for x in box):
        return "none"
    scale = 1000.0 if max(box) <= 1.5 else 1.0
    if box[3] * scale <= 60:
        return "top"
    return "bottom" if box[1] * scale >= 930 else "middle"


OUT = pa.schema(
    [
        ("doc_id", pa.string()), ("blk", pa.int32()), ("source_index", pa.int32()), ("page_idx", pa.int32()), ("role", pa.string()),
        ("defects", pa.list_(pa.string())), ("text", pa.string()), ("pending", pa.bool_()), ("para", pa.int32()), ("open_end", pa.bool_()),
        ("ask", pa.list_(pa.string())), ("from_word", pa.bool_()), ("to_word", pa.bool_()),
    ]
)
OUT_DDL = "doc_id string, blk int, source_index int, page_idx int, role string, defects array<string>, text string, pending boolean, para int, open_end boolean, ask array<string>, from_word boolean, to_word boolean"


def _lines(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x.strip()] if text else []


def element_features(row: tuple, page: Page) -> tuple[list[str], list[tuple[int, ...]]]:
    """The lines of one element that are not blank, and what is seen of each. Row: source_index, page_idx, type, text, level, zone."""
    _, page_idx, kind, text, level, zone = row
    own = _lines(text)
    if not own:
        return [], []
    if len(own) == 1:
        return own, [page.features(own[0], zone, True, kind or "", level is not None, page_idx)]
    full = max(map(len, own)) * 0.6
    return own, [
        page.features(x, zone, False, kind or "", level is not None, page_idx, 0 < i < len(own) - 1 and len(x) < full <= len(own[i - 1])) for i, x in enumerate(own)
    ]


def read_block(doc: str, blk: int, rows: list[tuple], words: Words, model: Model) -> Iterator[tuple]:
    """The elements of one block in reading order; the last row is the state at the block's end.

    A text that asks for forms that are not at hand comes as it is, with these forms in ``ask``.
    Rows: source_index, page_idx, type, text, level, zone, the package's ``Page``, and whether the
    element belongs to a neighbouring block and only helps to label its page.
    """
    at = 0
    open_, para, from_word = None, None, False  # open_: None until the block's first body element
    pending = False
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][1] == rows[at][1]:
            end += 1
        lines: list[tuple[int, str]] = []
        scores = []
        for k in range(at, end):
            own, seen_ = element_features(rows[k][:6], rows[k][6])
            lines.extend((k, x) for x in own)
            scores.extend(map(model.scores, seen_))
        labels = model.best(scores)
        by: dict[int, list[tuple[str, int]]] = {}
        for (k, x), label in zip(lines, labels):
            by.setdefault(k, []).append((x, label))
        for k in range(at, end):
            index, page_idx, _, text, level, _, page, beyond = rows[k]
            own = by.get(k)
            if not own or beyond:
                continue
            seen = {label for _, label in own}
            if seen <= {RUNNING, NUMBER}:
                role = "page_number" if seen == {NUMBER} else "running"
                yield doc, blk, index, page_idx, role, [role], None, False, None, None, None, None, None
                continue
            if BREAK in seen and BODY not in seen:
                if level is not None:
                    open_, from_word = False, False
                yield doc, blk, index, page_idx, "heading" if level is not None else "break", [], " ".join(text.split()), False, None, None, None, None, None
                continue
            defects = []
            body = [x for x, label in own if label in (BODY, BREAK)]
            if len(body) < len(own):
                defects.append("inline")
            flat = "\n".join(body)
            expected = page_idx + page.offset if page_idx is not None and page.offset is not None else None
            if page.anchors and len(own) == 1 and len(flat) > 40 and (at_line := find_running(flat, page, expected)):
                defects.append("inline")
                flat = flat[: at_line[0]] + flat[at_line[1] :].lstrip()
            if expected is not None and any(x in flat for x in _SET_OFF) and (len(own) == 1 or " - " in flat or " – " in flat or " — " in flat):
                for m in _INSIDE_NUMBER.finditer(flat):
                    # a number in brackets is cited where there are others
                    if (got := page_number(m[1])) and got[0] == expected and (m[1][0] != "[" or len(_CITED.findall(flat)) == 1):
                        defects.append("inline")
                        flat = flat[: m.start()] + " " + flat[m.end() :].lstrip()
                        break
            tail = flat.rstrip()
            to_word = tail[-1:] in HYPHENS
            listed = bool(_LIST.match(flat))
            if open_ and not listed:
                goes_on: bool | None = True
            elif open_ is None:
                goes_on = None
            else:
                goes_on = False
            first = flat.lstrip()[:1]
            inside = (from_word and goes_on is True) or (goes_on is None and first.islower())
            ask = sorted(asked(flat, words))
            clean, hyphen, misread = (flat, False, False) if ask else mend(flat, words, inside, to_word)
            if hyphen:
                defects.append("hyphen")
            if misread:
                defects.append("misread")
            if goes_on:
                defects.append("continued")
            elif goes_on is None:
                pending, para = True, index
            else:
                pending, para = False, index
            yield doc, blk, index, page_idx, "body", sorted(set(defects)), clean, pending, para, None, ask or None, inside, to_word
            if not (listed and open_):
                last = tail[-16:]
                open_ = not _CLOSED.search(last) or bool(_SEEMING.search(last))
                from_word = to_word
            pending = pending and open_ is not False
        at = end
    yield doc, blk, None, None, "block", [], None, pending, para, open_, None, None, None


def _zone(box: Column) -> Column:
    """As ``bbox_zone``."""
    ok = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull())
    scale = F.when(F.array_max(box) <= 1.5, 1000.0).otherwise(1.0)
    at = lambda i: F.try_element_at(box, F.lit(i)) * scale
    return F.when(~F.coalesce(ok, F.lit(False)), "none").when(at(4) <= 60, "top").when(at(2) >= 930, "bottom").otherwise("middle")


def vocabulary(elements: DataFrame) -> tuple[DataFrame, dict[str, int], int, float]:
    """Counts of all words over all texts, the frequent ones of them at hand, the number of all words, and the least count of the frequent.

    The number of frequent words is bounded by 1/VOCABULARY_SHARE, so they fit in one
    table. A word divided at a line end counts neither joined nor with its hyphen, as
    the counts are to tell which of the two it is.
    """
    divided = F.col("text").rlike(r"[-‐¬\x{AD}]\s")
    marked = F.when(divided, F.regexp_replace("text", r"(?<=\p{L})[-‐¬\x{AD}]\s+(?=\p{L})", EITHER)).otherwise(F.col("text"))
    # one blank is cut at much faster than a pattern
    for c in "\n\t\r\x0b\x0c\xa0":
        marked = F.replace(marked, F.lit(c), F.lit(" "))
    tokens = elements.filter("text is not null").select(F.explode(F.split(marked, " ")).alias("w")).filter("w <> ''")
    # count the tokens as they stand, then trim and fold each distinct one
    raw = tokens.groupBy("w").agg(F.count("*").alias("n")).filter(~F.contains("w", F.lit(EITHER)))
    words = raw.select(F.lower(F.btrim("w", F.lit(STRIP))).alias("w"), "n").filter(r"length(w) > 0 and w rlike '\\p{L}'")
    counts = checkpoint(words.groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # words of this share are at hand, the others are looked up: what is found is the same
    floor = max(2.0, VOCABULARY_SHARE * total)
    return counts, {r.w: r.n for r in counts.filter(F.col("n") >= floor).toLocalIterator()}, total, floor


def rare_words(counts: DataFrame, floor: float) -> DataFrame:
    """What a form may ask for among the words that are not frequent: form, word and its count.

    A form asks for itself and for the words that it can be a misread form of. The least
    counts are those that ``Words.printed`` demands of one and of two confusions.
    """
    least = MISREAD_RATIO * LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["form", "word", "n"])
            out.clear()
            return batch

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append((w, w, n))
                if n >= least and 2 <= len(w) <= LONGEST_WORD + 4 and not _CJK.search(w) and not any(c.isdigit() for c in w):
                    out.extend((x, w, n) for x in misread_forms(w, 2 if n >= 4 * least else 1))
                if len(out) > 20_000:
                    yield flush()
        if out:
            yield flush()

    return counts.filter(F.col("n") < floor).select("w", "n").mapInArrow(run, "form string, word string, n long")


def running_lines(elements: DataFrame) -> DataFrame:
    """What each stretch of ``SPAN`` places of a package can know of its pages: doc_id, cell, lines, offset.

    ``lines`` are the running lines of the stretch and of those next to it, by count, so
    their number is bounded by that of the stretches' elements; ``offset`` leads from page
    index to page number, by the most pages of the package.
    """
    cell = F.floor(F.col("source_index") / SPAN).cast("int")
    edge = elements.filter(F.col("zone").isin("top", "bottom") & F.col("text").isNotNull() & (F.length("text") < 200))
    number = F.concat(*[F.regexp_extract("text", x, 1) for x in PAGE_OF_LINE])
    keyed = edge.select("doc_id", cell.alias("cell"), F.lower(F.regexp_replace("text", r"\d+", "9")).alias("line"), (F.nullif(number, F.lit("")).cast("int") - F.col("page_idx")).alias("offset"))
    # distinct lines and offsets, of which there are few beside the elements; both results start from this shuffle
    seen = keyed.groupBy("doc_id", "cell", "line", "offset").agg(F.count("*").alias("n"))
    near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    lines = seen.filter(r"line rlike '\\p{L}{3}'").select("doc_id", near, "line", "n").groupBy("doc_id", "cell", "line").agg(F.sum("n").alias("n"))
    lines = lines.groupBy("doc_id", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "line"))), lambda x: x["line"]).alias("lines"))
    offsets = seen.filter("offset is not null").groupBy("doc_id", "offset").agg(F.sum("n").alias("n"))
    offset = offsets.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", "offset")).alias("offset"))
    cells = elements.groupBy("doc_id").agg(F.max(cell).alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("cell"))
    return cells.join(lines, ["doc_id", "cell"], "left").join(offset, "doc_id", "left")


def sure_pages(rows: list[tuple], known: dict[tuple, tuple]) -> list[list[tuple[tuple[int, ...], int]]]:
    """Pages of (features, label) to fit the weights by, from elements in the order of their pages.

    Rows: doc_id, then as for ``element_features``; ``known``: (doc_id, cell) -> lines and
    offset. Lines of elements with a box are sure: alone at an edge they are running
    matter or a number; in the middle they are a heading, an equation, or body, but a
    running line exactly as known, or the number of the page. Each page is seen as it
    is, with a running line and its number put into its longest text, and with a part
    of its boxes, types and page numbers hidden.
    """
    out: list[list[tuple[tuple[int, ...], int]]] = []
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] == rows[at][0] and rows[end][2] == rows[at][2]:
            end += 1
        elements = [(*x[1:], Page(*known.get((x[0], x[1] // SPAN), ([], None)))) for x in rows[at:end] if x[6] and _lines(x[4])]
        at = end
        if not elements:
            continue
        page: Page = elements[0][6]
        exact = {k for ks in page.keys.values() for k in ks}

        def label(x: str, zone: str, alone: bool, kind: str, level: int | None, page_idx: int | None, page=page, exact=exact) -> int | None:
            number = page_number(x) if len(x) < 24 else None
            if level is not None or kind == "equation":
                return BREAK
            if zone in ("top", "bottom") and alone:
                return NUMBER if number else RUNNING
            if zone != "middle":
                return None
            if alone and _EQUATION.fullmatch(x):
                return BREAK
            if alone:
                return BODY
            if number:
                return NUMBER if page.offset is not None and page_idx is not None and number[0] == page_idx + page.offset else BODY
            key = running_key(x)
            return RUNNING if key in exact else None if same_line(key, page.keys) else BODY

        turn = len(out)
        longest = max(range(len(elements)), key=lambda k: len(elements[k][3]))
        body = elements[longest]
        put = None
        if exact and body[4] is None and body[5] == "middle" and len(_lines(body[3])) > 1:
            key = sorted(exact)[turn % len(exact)]
            own = _lines(body[3])
            cut = 1 + turn % (len(own) - 1)
            line = key.title() if turn % 2 or page.offset is None or body[1] is None else ("[%d]", "- %d -", "%d")[turn % 3] % (body[1] + page.offset)
            put = (cut, line, RUNNING if line == key.title() else NUMBER)
        for view in range(4):
            page_out: list[tuple[tuple[int, ...], int]] = []
            for k, (index, page_idx, kind, text, level, zone, of) in enumerate(elements):
                own = _lines(text)
                labels = [label(x, zone, len(own) == 1, kind or "", level, page_idx) for x in own]
                hide = (turn + k + view) % 3 if view > 1 else -1
                if view % 2 and put and k == longest:
                    own, labels = own[: put[0]] + [put[1]] + own[put[0] :], labels[: put[0]] + [put[2]] + labels[put[0] :]
                    if body[1] is not None and page.offset is not None:
                        # a number at the end of a text that is not the page's, or can't be told to be
                        own, labels = [*own, str(body[1] + page.offset + (0 if hide == 1 else 37))], [*labels, BODY]
                shown = (index, None if hide == 1 else page_idx, None if hide == 2 else kind, "\n".join(own), level, "none" if hide == 0 else zone)
                for f, y in zip(element_features(shown, of)[1], labels):
                    if hide == 1 and y == NUMBER and _AT["number, among lines, plain"] in f:
                        y = BODY
                    if hide == 0 and len(own) == 1 and y in (RUNNING, NUMBER) and not ({_AT["running line"], _AT["typed as header, no box, short"], _AT["typed as number, no box"]} & set(f)):
                        y = None  # nothing is left to tell it by
                    if y is not None:
                        page_out.append((f, y))
            if page_out:
                out.append(page_out)
    return out


def fitted_model(elements: DataFrame, known: DataFrame) -> Model:
    """The chain's weights from about ``SAMPLE`` elements of whole pages, picked by a hash; the sample is bounded, so it is fitted on the driver."""
    total = elements.count()
    share = min(1.0, SAMPLE / max(1, total))
    place = F.pmod(F.xxhash64("doc_id", "page_idx"), F.lit(1 << 20))
    picked = elements.filter((F.length("text") < SAMPLE_TEXT) & F.col("page_idx").isNotNull() & (place < int(share * (1 << 20)) + 1))
    rows = picked.select("doc_id", "source_index", "page_idx", "type", "text", "level", "zone").limit(2 * SAMPLE).collect()
    rows = sorted({(r.doc_id, r.page_idx, r.source_index): tuple(r) for r in rows}.items())
    rows = [r for _, r in rows]
    if not rows:
        return Model()
    keys = elements.sparkSession.createDataFrame(sorted({(r[0], r[1] // SPAN) for r in rows}), "doc_id string, cell int")
    lines = {(r.doc_id, r.cell): (r.lines or [], r.offset) for r in known.join(F.broadcast(keys), ["doc_id", "cell"]).collect()}
    return Model.fitted(sure_pages(rows, lines))


def mended(read: DataFrame, counts: DataFrame, table, floor: float) -> DataFrame:
    """The elements that ``read_block`` gives, those with forms to ask for mended with their counts."""
    waiting = read.filter("ask is not null")
    asks = waiting.select("doc_id", "source_index", F.explode("ask").alias("form"))
    found_ = asks.join(rare_words(counts, floor), "form").groupBy("doc_id", "source_index").agg(F.collect_set(F.struct("word", "n")).alias("rare"))
    names = [f.name for f in OUT]
    answered = waiting.join(found_, ["doc_id", "source_index"], "left").select(*names, "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*table.value[:2])
        for b in batches:
            texts, defects = [], []
            for text, old, inside, to_word, rare in zip(*[b.column(c).to_pylist() for c in ("text", "defects", "from_word", "to_word", "rare")]):
                words.rare = {r["word"]: r["n"] for r in rare or ()}
                clean, hyphen, misread = mend(text, words, inside, to_word)
                texts.append(clean)
                defects.append(sorted({*old, *(["hyphen"] if hyphen else []), *(["misread"] if misread else [])}))
            new = {"text": pa.array(texts, pa.string()), "defects": pa.array(defects, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names=names)

    return read.filter("ask is null").unionByName(answered.mapInArrow(run, OUT_DDL))


def label_elements(elements: DataFrame) -> DataFrame:
    """Each element with text once: doc_id, source_index, page_idx, role, defects, text (mended), para.

    ``para`` is the source_index of the element in which the paragraph begins. Of an
    element delivered more than once the last delivery counts. Null and blank texts
    give no row; texts are never cut; elements without a box, page or source are
    judged by their text alone.
    """
    spark = elements.sparkSession
    base = elements.select("doc_id", "source_index", "page_idx", "type", "text", F.col("text_level").cast("int").alias("level"), _zone(F.col("bbox")).alias("zone"), "received_at").filter("doc_id is not null and source_index is not null")
    with_text = base.filter("text is not null")
    counts, frequent, total, floor = vocabulary(with_text)
    known = checkpoint(running_lines(base))
    table = spark.sparkContext.broadcast((frequent, total, fitted_model(with_text, known)))
    first_block, last_block = (F.floor((F.col("cell") * SPAN + x) / BLOCK).cast("int") for x in (-MARGIN, SPAN - 1 + MARGIN))
    info = known.withColumn("blk", F.explode(F.sequence(F.greatest(F.lit(0), first_block), last_block))).select(
        "doc_id", "blk", (F.col("cell") * SPAN).alias("source_index"), F.col("offset").alias("page_idx"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("zone"), F.lit(None).cast("timestamp").alias("received_at"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"),
    )
    at, own = F.pmod("source_index", F.lit(BLOCK)), F.floor(F.col("source_index") / BLOCK).cast("int")
    # an element near the end of a block is shown to the next one too
    seen_by = F.filter(F.array(own, F.when((at < MARGIN) & (own > 0), own - 1), F.when(at >= BLOCK - MARGIN, own + 1)), lambda x: x.isNotNull())
    rows = with_text.select("doc_id", F.explode(seen_by).alias("blk"), "source_index", "page_idx", "type", "text", "level", "zone", "received_at", F.lit(None).cast("array<string>").alias("lines"))
    order = ["doc_id", "blk", "source_index", F.col("lines").isNull(), F.desc("received_at"), F.xxhash64("text", "type")]
    merged = rows.unionByName(info.select(*rows.columns)).repartition("doc_id", "blk").sortWithinPartitions(*order)
    merged = merged.select("doc_id", "blk", "source_index", "page_idx", "type", "text", "level", "zone", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, total, model = table.value
        words = Words(frequent, total)
        key, page, held = None, Page([], None), []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * len(OUT)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT)], schema=OUT)
            out.clear()
            return batch

        for b in batches:
            for doc, blk_, index, page_idx, kind, text, level, zone, lines in zip(*[c.to_pylist() for c in b.columns]):
                if (doc, blk_) != key:
                    if held:
                        out.extend(read_block(*key, held, words, model))
                    key, page, held = (doc, blk_), Page([], None), []
                if lines is not None:
                    page = Page(lines, page_idx)
                elif not held or held[-1][0] != index:
                    held.append((index, page_idx, kind, text, level, zone, page, index // BLOCK != blk_))
            if len(out) > 4000:
                yield flush()
        if held:
            out.extend(read_block(*key, held, words, model))
        yield flush()

    read = checkpoint(merged.mapInArrow(run, OUT_DDL))
    # the state with which a block begins: one row for each block
    ends = read.filter("role = 'block'").select("doc_id", "blk", "open_end", "para")
    earlier = Window.partitionBy("doc_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("doc_id", "blk", F.last("open_end", True).over(earlier).alias("opened"), F.last("para", True).over(earlier).alias("opened_para")).filter("opened")
    body = mended(read.filter("role <> 'block'"), counts, table, floor)
    settled = body.filter("not pending").select("doc_id", "source_index", "page_idx", "role", "defects", "text", "para")
    waiting = body.filter("pending").join(begins, ["doc_id", "blk"], "left")
    joined = F.coalesce("opened", F.lit(False))
    first = F.col("source_index") == F.col("para")
    waiting = waiting.select(
        "doc_id", "source_index", "page_idx", "role",
        F.when(joined & first, F.array_sort(F.array_union("defects", F.array(F.lit("continued"))))).otherwise(F.col("defects")).alias("defects"),
        "text", F.when(joined, F.col("opened_para")).otherwise(F.col("para")).alias("para"),
    )
    return settled.unionByName(waiting)


def found(labelled: DataFrame) -> DataFrame:
    """One row for each element and defect."""
    return labelled.select("doc_id", "source_index", F.explode("defects").alias("defect")).distinct()


def paragraphs(labelled: DataFrame) -> DataFrame:
    """Continuous paragraphs and headings without traces of the page: doc_id, page_idx, para, kind, text, elements.

    ``page_idx`` is the page on which the paragraph begins; -1 where it is not known.
    """
    rows = labelled.filter("role in ('body', 'heading')").select("doc_id", "role", "source_index", "page_idx", "text", F.coalesce("para", "source_index").alias("para"))
    parts = rows.groupBy("doc_id", "para").agg(
        F.sort_array(F.collect_list(F.struct("source_index", "text"))).alias("parts"),
        F.coalesce(F.min_by("page_idx", "source_index"), F.lit(-1)).alias("page_idx"),
        F.min_by("role", "source_index").alias("kind"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\x01")
    text = F.regexp_replace(F.regexp_replace(joined, "[-‐¬­]\x01", ""), "\x01", " ")
    return parts.select("doc_id", "page_idx", "para", "kind", text.alias("text"), F.size("parts").alias("elements"))
