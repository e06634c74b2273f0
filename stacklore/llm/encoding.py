"""Problem 10: text garbled by a wrong character encoding.

Noisy-channel decoding. A channel says in which encoding bytes were written and in which
they were read. Undoing it turns a token's characters into bytes again; a character that
stands for a lost byte becomes a wildcard, and the lattice of all bytes that could
stand there is decoded. What comes out is scored by the words and letter pairs of the
whole corpus; the token itself by the letter pairs of all other tokens. How often a channel
damages tokens is learned from those that are plain cases. A Viterbi search over the tokens of
a document chooses the spans that were damaged, and by which channel. Samples quoted between
back-ticks are left alone.

Every distinct token is resolved once, and its readings are looked up in the table of all
words, so that no word is left out of the model; only the letter pairs are held in memory, as counts
in a fixed number of cells.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import semi_by_ids
from stacklore.storage import cut

#: Cells in which letter pairs are counted; pairs that fall into one cell are counted together.
CELLS = 1 << 20
#: Readings of tokens that are broadcast at most, after they were counted.
READINGS = 100_000
#: Encodings in which UTF-8 bytes were read, and (read, written) of one-byte encodings. Fixed values.
READ_UTF8 = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_15", "koi8_r", "cp866")
ONE_BYTE = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"),
    ("cp1252", "cp850"), ("latin-1", "cp1252"), ("latin-1", "mac_roman"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("cp1251", "cp1252"),
)
#: What it costs to enter a span damaged by UTF-8 bytes, or by a one-byte encoding.
ENTER_UTF8, ENTER_BYTE = 2.0, 14.0
#: Evidence that a character restored from several valid UTF-8 bytes is not there by chance.
SEQUENCE = 3.0
#: Evidence of a control character beyond ASCII, which no sound text holds.
CONTROL = 8.0
#: What it costs a damaged span to go on over a token that its channel does not touch.
CARRY = 1.0
#: Lost bytes of a token up to which all its readings are scored; with more, the best by its letter pairs is searched.
WILDCARDS = 2
LOST = "�"

_SHAPE = "lost bytes; "

_QUOTED = re.compile(r"`[^`\n]*`")
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_EDGE = ".,;:!?()\"'"
_DIGIT = re.compile("[0-9]+")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
#: Latin, Greek, Cyrillic, punctuation, currency and letter-like signs: what one or two valid sequences may stand for.
_COMMON = re.compile("[\xa0-\u024f\u0370-\u045f\u1e00-\u1eff\u2010-\u204f\u20a0-\u20bf\u2100-\u214f]")
#: Letters of two scripts side by side, and what it costs to restore a token to that.
_MIXED = re.compile("[A-Za-z\xc0-\u024f][\u0370-\u045f]|[\u0370-\u045f][A-Za-z\xc0-\u024f]")
MIXED = 12.0
#: Log of the share of letter pairs that were never seen.
_UNSEEN = -7.0


def _table(name: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


_TABLES = {name: _table(name) for name in {*READ_UTF8, *(r for r, _ in ONE_BYTE)}}
_BACK = {w: {b: c for c, b in _table(w).items()} for w in {w for _, w in ONE_BYTE}}


def _open_bytes(name: str) -> list[int]:
    """Bytes that a reader in this encoding may have lost: those it does not define, else all."""
    missing = [b for b in range(128, 256) if not _defined(b, name)]
    return missing or list(range(128, 192))


def _defined(b: int, name: str) -> bool:
    try:
        bytes([b]).decode(name)
    except UnicodeDecodeError:
        return False
    return True


_OPEN = {name: _open_bytes(name) for name in READ_UTF8}
#: What may stand for a byte that a one-byte reader lost, and how long the UTF-8 sequence of a first byte is.
_LOST_BYTES = {read: [b for b in range(128, 256) if not _defined(b, read)] for read, _ in ONE_BYTE}
_LENGTH = [1] * 128 + [0] * 66 + [2] * 30 + [3] * 16 + [4] * 5 + [0] * 11


def _from_utf8(token: str, read: str, model: Model | None = None):
    """Texts that, written in UTF-8 and read in ``read``, could give the token: all, or with many lost bytes the model's best."""
    table = _TABLES[read]
    try:
        data = [-1 if c == LOST else table[c] for c in token]
    except KeyError:
        return
    holes = [i for i, b in enumerate(data) if b < 0]
    if max(data) < 128:
        return
    if len(holes) > WILDCARDS:
        text = model.best_utf8(data, read) if model else None
        if text is not None:
            yield text
        return
    for fill in itertools.product(_OPEN[read], repeat=len(holes)):
        for i, b in zip(holes, fill, strict=True):
            data[i] = b
        try:
            text = bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            continue
        yield text


def restorations(token: str, model: Model | None = None):
    """(channel, text, restored sequences) for every channel that can be undone."""
    done = {token}
    layer = [("", token, 0)]
    for _ in range(3):  # read wrongly up to three times
        found = []
        for name, text, count in layer:
            for read in READ_UTF8:
                for out in _from_utf8(text, read, model):
                    if out not in done and len(out) < len(text):
                        done.add(out)
                        found.append((f"{name}utf-8 as {read}; ", out, count + sum(c > "\x7f" for c in out)))
        yield from found
        layer = found
    for read, written in ONE_BYTE:
        table, back = _TABLES[read], _BACK[written]
        if LOST in token:
            for out in model.from_byte(token, read, written) if model else ():
                yield f"{written} as {read}; ", out, 0
            continue
        try:
            out = "".join([c if c < "\x80" else back[table[c]] for c in token])
        except KeyError:
            continue
        if out != token:
            yield f"{written} as {read}; ", out, 0


def _form(token: str) -> str:
    return _DIGIT.sub("0", token)


def _suspicious(token: str) -> bool:
    """Whether the token reads as UTF-8 in some encoding; such tokens do not teach the model."""
    if LOST in token:
        return True
    for read in READ_UTF8:
        for text in _from_utf8(token, read):
            new = [c for c in text if c > "\x7f"]
            if len(new) > 2 or not any(c for c in new if not _COMMON.match(c)):
                return True
    return False


def _cell(a: str, b: str) -> int:
    return ((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA6B >> 17) & (CELLS - 1)


def _learn(counts: Iterable[tuple[str, int]]) -> dict[tuple[int, int], int]:
    """Counts by (kind, key): cells of letter pairs (0), first letters of pairs (1), second letters (2)."""
    out: dict[tuple[int, int], int] = {}
    for token, n in counts:
        for a, b in itertools.pairwise(f"\x02{token}\x03"):
            for key in ((0, _cell(a, b)), (1, ord(a)), (2, ord(b))):
                out[key] = out.get(key, 0) + n
    return out


class Model:
    """Scores of tokens by the letter pairs of the corpus."""

    def __init__(self, counts: Iterable[tuple[int, int, int]]):
        """From (kind, key, n) as ``_learn`` counts them."""
        self.cells = np.zeros(CELLS, np.int64)
        self.first: dict[str, int] = {}
        self.letters: dict[str, int] = {}
        for kind, key, n in counts:
            if kind:
                (self.first if kind == 1 else self.letters)[chr(key)] = n
            else:
                self.cells[key] = n
        self.all = max(1, sum(self.letters.values()))
        self.filled: dict[tuple, list[str]] = {}

    @classmethod
    def of(cls, tokens: dict[str, int]) -> Model:
        return cls((kind, key, n) for (kind, key), n in _learn(tokens.items()).items())

    def step(self, a: str, b: str, pair: int = 0, first: int = 0, second: int = 0) -> float:
        """The score of letter b after a, less so many occurrences of them."""
        n, m = self.cells.item(_cell(a, b)) - pair if a else 0, self.first.get(a, 0) - first
        if n > 0 and m > 0:
            return min(0.0, log(n / m))
        k = self.letters.get(b, 0) - second
        return _UNSEEN + (log(k / self.all) if k > 0 else log(0.1 / self.all) + _UNSEEN)

    def score(self, form: str, own: int = 0) -> float:
        """The score of a token by its letter pairs, less what ``own`` occurrences of it taught."""
        text = f"\x02{form}\x03"
        pairs = list(itertools.pairwise(text))
        if not own:
            return sum(self.step(a, b) for a, b in pairs)
        twice, first, second = Counter(pairs), Counter(text[:-1]), Counter(text[1:])
        return sum(self.step(a, b, own * twice[a, b], own * first[a], own * second[b]) for a, b in pairs)

    def best(self, size: int, choices) -> str | None:
        """The text of greatest score by letter pairs; choices(i): (next place, letters) of what can stand at place i.

        A Viterbi search whose states are the place and the last letter; letters that begin
        no known pair are one state.
        """
        states: list[dict[str, tuple]] = [{} for _ in range(size + 1)]
        states[0]["\x02"] = (0.0, None, "", "")
        for i in range(size):
            if not states[i]:
                continue
            for j, letters in choices(i):
                for c in letters:
                    b = _form(c)
                    score, a = max((s[0] + self.step(a, b), a) for a, s in states[i].items())
                    key = b if b in self.first else ""
                    if key not in states[j] or score > states[j][key][0]:
                        states[j][key] = (score, i, a, c)
        if not states[size]:
            return None
        at, last = size, max((s[0] + self.step(a, "\x03"), a) for a, s in states[size].items())[1]
        out = []
        while at:
            _, at, last, c = states[at][last]
            out.append(c)
        return "".join(out[::-1])

    def fills(self, part: tuple[int, ...], read: str) -> list[str]:
        """The letters that the bytes can be, -1 for a lost one; of those never seen only the first."""
        key = (read, *part)
        if key not in self.filled:
            known, other = [], []
            for fill in itertools.product(*[_OPEN[read] if b < 0 else (b,) for b in part]):
                try:
                    c = bytes(fill).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if c in self.letters or c in self.first:
                    known.append(c)
                elif not other:
                    other.append(c)
            self.filled[key] = known + other
        return self.filled[key]

    def best_utf8(self, data: list[int], read: str) -> str | None:
        """The best text of UTF-8 bytes, -1 for a lost one, that were read in ``read``."""

        def choices(i: int):
            sizes = {_LENGTH[b] for b in (_OPEN[read] if data[i] < 0 else data[i : i + 1])} - {0}
            return [(i + n, self.fills(tuple(data[i : i + n]), read)) for n in sizes if i + n <= len(data)]

        return self.best(len(data), choices)

    def from_byte(self, token: str, read: str, written: str) -> list[str]:
        """Texts of a one-byte encoding, read in one that lost bytes: all, or with many the best; none if no other letter shows the channel."""
        table, back = _TABLES[read], _BACK[written]
        letters = []
        for c in token:
            if c == LOST:
                letters.append([back[b] for b in _LOST_BYTES[read] if b in back])
            elif c < "\x80":
                letters.append([c])
            else:
                letters.append([back[table[c]]] if table.get(c) in back else [])
        if not all(letters) or all(c < "\x80" or c == LOST for c in token):
            return []
        if token.count(LOST) <= WILDCARDS:
            return ["".join(x) for x in itertools.product(*letters)]
        best = self.best(len(token), lambda i: [(i + 1, letters[i])])
        return [] if best is None else [best]


def decode(tokens: list[str], options: dict[str, list]) -> list[tuple[str, str]]:
    """The best (channel, text) of each token form; channel '' where nothing was wrong.

    options: by token, its readings as (channel, text, gain over the token, cost to enter the channel).
    """
    states: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    for token in tokens:
        best = max(states.items(), key=lambda s: s[1][0])
        new = {"": (best[1][0], (best[1][1], "", token))}
        for channel, (score, path) in states.items():  # a sound token within a damaged span
            if channel and score - CARRY > best[1][0] - ENTER_BYTE:
                new[channel] = (score - CARRY, (path, "", token))
        for channel, text, gain, enter in options.get(token, ()):
            stay = states.get(channel, (-1e18, None))
            score, path = stay if stay[0] >= best[1][0] - enter else (best[1][0] - enter, best[1][1])
            if score + gain > new.get(channel, (-1e18,))[0]:
                new[channel] = (score + gain, (path, channel, text))
        states = new
    path = max(states.values(), key=lambda s: s[0])[1]
    out = []
    while path is not None:
        out.append((path[1], path[2]))
        path = path[0]
    return out[::-1]


def repair(text: str, options: dict[str, list]) -> tuple[str, list[str], bool]:
    """(restored text, channels undone, whether damage is left)."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    spans, tokens = [], []
    for m in _TOKEN.finditer(_QUOTED.sub(lambda m: " " * len(m.group()), text) if quoted else text):
        word = m.group()
        if word.isascii():
            continue
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        spans.append((m.start() + left, m.start() + left + len(core)))
        tokens.append(core)
    if not tokens:
        return text, [], False
    out, at, channels, open_damage = [], 0, set(), False
    for (start, end), token, (channel, new) in zip(spans, tokens, decode([_form(t) for t in tokens], options), strict=True):
        if channel:
            channels.add(channel.strip("; "))
            numbers = iter(_DIGIT.findall(token))  # readings have their digits folded
            new = _DIGIT.sub(lambda m: next(numbers, m.group()), new)  # noqa: B023
        else:
            new = token
        out += [text[at:start], new]
        at = end
        open_damage |= LOST in new or bool(_CONTROL.search(new))
    return "".join([*out, text[at:]]), sorted(channels), open_damage


def _forms(text: Column) -> Column:
    """The tokens of a text that have a character beyond ASCII, outside back-ticks, without edges and with their digits folded."""
    unquoted = F.regexp_replace(text, "`[^`\\n]*`", " ")
    words = F.regexp_extract_all(unquoted, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: w.rlike(r"[^\x00-\x7f]")), lambda w: F.regexp_replace(F.btrim(w, F.lit(_EDGE)), "[0-9]+", "0"))


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """(token, n) of all tokens with a character beyond ASCII, over the whole corpus; digits folded."""
    rows = texts.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.explode(_forms(F.col(text))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _judge(batches):
    """Adds whether the token looks sound, so that it may teach the model."""
    for batch in batches:
        sound = [not _suspicious(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sound, pa.bool_())], names=["token", "n", "sound"])


def _teach(batches):
    for batch in batches:
        counts = _learn(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        kinds, keys = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(counts.values(), pa.int64())], names=["kind", "key", "n"])


def train(tokens: DataFrame) -> Model:
    """Letter pairs of all sound tokens(token, n, sound): at most CELLS rows and two for every letter come to the driver."""
    learned = tokens.filter("sound").select("token", "n").mapInArrow(_teach, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    return Model(zip(*(learned.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True))


def _reader(model: Model, total: float):
    def read(batches):
        for batch in batches:
            rows = []
            for token, n, sound in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                alone = model.score(token, n if sound else 0)
                own = max(model.score(token), log(n / total)) if sound else alone
                marks = len(_CONTROL.findall(token))
                for channel, text, count in restorations(token, model):
                    bonus = SEQUENCE * count - MIXED * bool(_MIXED.search(text)) + CONTROL * (marks - len(_CONTROL.findall(text)))
                    rows.append((token, n, channel, text, model.score(text) - own + bonus, bonus - own, bonus - alone))
                if LOST in token:  # the most used word of that shape is looked up
                    rows.append((token, n, _SHAPE, token, -1e9, -own, -alone))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 3)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "n", "channel", "text", "by_letters", "by_word", "by_better"])

    return read


#: A reading that is a word FREQUENT times as frequent as the token, which has more than a letter.
FREQUENT = 4


def _clearer() -> Column:
    return (F.col("times") >= FREQUENT * F.col("n")) & (F.length("token") > 1)


def readings(tokens: DataFrame) -> DataFrame:
    """(token, channel, text, gain, enter): the readings of tokens(token, n, sound) that may be better than the tokens as they stand.

    A reading is scored by its letter pairs or as a word of the corpus, whichever is better, and
    so is the token. Beside a reading that is a more frequent word, the token counts as new: the
    occurrences of a damaged word do not speak for it. A one-byte channel costs ENTER_BYTE to
    enter; for a more frequent word it costs what the channel's share of all tokens says, as
    far as plain cases were seen.
    """
    total = float(max(1, tokens.agg(F.sum("n")).first()[0] or 0))
    read = tokens.mapInArrow(_reader(train(tokens), total), "token string, n bigint, channel string, text string, by_letters double, by_word double, by_better double")
    sound = tokens.filter("sound")
    words = sound.select(F.col("token").alias("text"), F.col("n").alias("times"))
    shapes = sound.groupBy(F.regexp_replace("token", r"[^\x00-\x7f]", LOST).alias("text")).agg(F.max(F.struct("n", "token")).alias("most"))
    read = cut(read)
    known = read.filter(F.col("channel") != _SHAPE).join(words, "text", "left")
    lost = read.filter(F.col("channel") == _SHAPE).join(shapes, "text").select(F.col("most.token").alias("text"), *[c for c in read.columns if c != "text"], F.col("most.n").alias("times"))
    better = F.when(_clearer(), F.col("by_better")).otherwise(F.col("by_word"))
    gain = F.greatest("by_letters", better + F.log(F.col("times") / total))
    scored = known.unionByName(lost).withColumn("gain", gain).filter(F.col("gain") > -CARRY)  # else a damaged span rather goes on over it
    narrow = ~F.col("channel").startswith("utf-8") & (F.col("channel") != _SHAPE)
    enter = F.when(narrow, F.lit(ENTER_BYTE)).when(F.col("channel") == _SHAPE, 0.0).otherwise(F.lit(ENTER_UTF8))
    scored = cut(scored.select("token", "n", "channel", "text", "gain", "times", enter.alias("enter"), narrow.alias("narrow")))
    plain = scored.groupBy("token", "n").agg(F.max(F.struct(F.col("gain") - F.col("enter"), "channel", "narrow")).alias("best")).filter((F.col("best.col1") > 0) & F.col("best.narrow"))
    share = {r["channel"]: r["n"] / total for r in plain.groupBy("best.channel").agg(F.sum("n").alias("n")).collect()}  # a row per channel
    learned = F.lit(ENTER_BYTE)
    for channel, part in sorted(share.items()):
        learned = F.when(F.col("channel") == channel, F.lit(max(ENTER_UTF8, min(ENTER_BYTE, -log(part))))).otherwise(learned)
    return scored.select("token", "channel", "text", "gain", F.when(F.col("narrow") & _clearer(), learned).otherwise(F.col("enter")).alias("enter"))


def _repairer(batches):
    for batch in batches:
        rows = []
        for i, text, read in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            options = {r["token"]: [(x["channel"], x["text"], x["gain"], x["enter"]) for x in r["options"]] for r in read}
            restored, channels, left = repair(text, options)
            if channels or left:
                rows.append((i, restored, channels, not left))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "restored", "channels", "complete"])


def repair_encoding(texts: DataFrame) -> DataFrame:
    """Records of texts(id bigint, text) that hold wrongly decoded text, with the text restored.

    Returns id, restored, channels (what was undone), complete: one row per damaged record.
    complete is false where characters are left that no channel explains. Null and empty
    texts and texts without damage yield no row; rows without an id and repeated rows are records
    of their own.
    """
    rows = texts.select(F.col("id").cast("bigint").alias("id"), "text").filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    tokens = cut(token_counts(texts.select("text"), "text").mapInArrow(_judge, "token string, n bigint, sound boolean"))
    options = readings(tokens).groupBy("token").agg(F.collect_list(F.struct("channel", "text", "gain", "enter")).alias("options"))
    open_ = tokens.filter(F.col("token").rlike(f"[\x80-\x84\x86-\x9f{LOST}]")).select("token")
    options = cut(options.join(open_, "token", "full").select("token", F.coalesce("options", F.array().cast(options.schema["options"].dataType)).alias("options")))

    row = F.xxhash64("id", "text").alias("row")  # rows that share it share their tokens or are looked at in vain
    met = rows.select(row, F.explode(F.array_distinct(_forms(F.col("text")))).alias("token"))
    few = options.limit(READINGS + 1).count() <= READINGS
    met = cut(met.join(F.broadcast(options) if few else options, "token").groupBy("row").agg(F.collect_set(F.struct("token", "options")).alias("read")))  # the tokens of a text
    found = semi_by_ids(rows.select("id", "text", row), met.select("row"), "row").join(met, "row")
    return found.select("id", "text", "read").mapInArrow(_repairer, "id bigint, restored string, channels array<string>, complete boolean")
