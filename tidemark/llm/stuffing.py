"""Pages made of repeated keywords, links and tags instead of sentences."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Longest block, in characters; a longer stretch of one kind is cut.
BLOCK = 2048
SENTENCES, RECORDS, REST, FRAGMENTS, TAGS = 0, 1, 2, 3, 4

#: Least and most words of a sentence; pieces with fewer are fragments.
SHORTEST, LONGEST = 6, 80

#: Script classes of a block, told from where its letters lie.
SCRIPTS = ("latin", "hangul", "han", "kana", "cyrillic", "greek", "arabic", "hebrew", "indic", "southeast", "other")

# First and last code points of the scripts, and how many of their letters stand for one word where words are not single units of writing.
RANGES = (
    (0x0041, 0x024F, 0, 0), (0x0370, 0x03FF, 5, 0), (0x0400, 0x052F, 4, 0), (0x0590, 0x05FF, 7, 0), (0x0600, 0x077F, 6, 0), (0x0900, 0x0DFF, 8, 0), (0x0E00, 0x0EFF, 9, 4),
    (0x1000, 0x109F, 9, 4), (0x1780, 0x17FF, 9, 4), (0x1E00, 0x1EFF, 0, 0), (0x3040, 0x30FF, 3, 2), (0x3400, 0x9FFF, 2, 2), (0xAC00, 0xD7A3, 1, 2.2), (0x20000, 0x3FFFF, 2, 2),
)

_END = re.compile(r"[.!?…؟।۔]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』”’)]*")
_END_ASCII = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
_NUMBERED = re.compile(r"(?:^|\W)\d{1,2}$")
_STOP_SIGNS = tuple(".!?…؟।۔。！？")
_AFTER_STOP = " \t\"'”’»)]」』"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_WORD_ASCII = re.compile(r"[a-z]+(?:'[a-z]+)*")
_LINK = r"(?:h(?:tt|xx)ps?://|www[.\[])[^\s<>\"]+"
_TAGGED = re.compile(_LINK + r"|\$[A-Z]{2,6}\b|#[^\s#]+|\b[A-Z]{1,4}-\d{2,6}\b", re.IGNORECASE)
_SIGN = re.compile(r"[$#]|://|www|[A-Za-z]-\d", re.IGNORECASE)
# any letter of a script without blanks between words
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, script, per in RANGES if per and script != 1) + "]")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff]")
# what fields of data look like in any language: dates, times, decimals, pairs, quoted keys, mixed identifiers; and plain numbers
_MARK = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}:\d\d|\b\d+\.\d+|\w+=[^\s\"']|\"\w+\":|\b(?=[a-z]*\d)(?=\d*[a-z])[0-9a-z]{8,}\b")
_NUMBER = re.compile(r"\b\d+\b")
_KEY = re.compile(r"\s*([^\W\d]\w{0,20}): \S|-{3,}\s*$")
_RULE = re.compile(r"^\s*\|[\s:|-]*-{3}[\s:|-]*\|\s*$", re.MULTILINE)
_ITEMS = re.compile(r"[\n,;|/·•、，；،]|\s[-–>]\s|[.!?]\s|[。！？]")
_TOKEN = re.compile(rf"({_LINK})|(\$[A-Z]{{2,6}}\b)|(#[^\s#]+)|([^\W\d_]+)|(\d+)|(\s+)", re.IGNORECASE)


@lru_cache(1 << 16)
def _place(letter: str) -> tuple[int, float]:
    """The script of a letter, and how many letters make a word (0: words are written apart)."""
    at = ord(letter)
    for first, last, script, per in RANGES:
        if first <= at <= last:
            return script, per
    return len(SCRIPTS) - 1, 0


def script_of(text: str) -> int:
    """The script of most of the letters, each word going by its first one."""
    if text.isascii():
        return 0
    letters = [0] * len(SCRIPTS)
    for w in _WORD.findall(text):
        letters[_place(w[0])[0]] += len(w)
    return letters.index(max(letters))


def _bare(text: str) -> str:
    """Without links and tags."""
    return _TAGGED.sub(" ", text) if _SIGN.search(text) else text


def words_of(text: str) -> tuple[float, list[str]]:
    """How many words the text has, and its units in lower case: words, or pairs of letters where words are not written apart."""
    if text.isascii():
        found = _WORD_ASCII.findall(text.lower())
        return len(found), found
    found = _WORD.findall(text.lower())
    if not _UNSPACED.search(text):
        return len(found) + sum([len(w) / 2.2 - 1 for w in found if len(w) > 2 and "가" <= w[0] <= "힣"]), found
    count, units = 0.0, []
    for w in found:
        script, per = _place(w[0])
        if not per:
            count += 1
        elif len(w) > per:
            count += len(w) / per
        else:
            count += 1
        # pairs of letters in scripts without blanks
        if per and script != 1:
            units += [w[i : i + 2] for i in range(0, max(1, len(w) - 1))]
        else:
            units.append(w)
    return count, units


def is_sentence(piece: str, plain: bool = False) -> bool:
    """Ends with a stop after as many words as sentences have, most of them different; links and tags are no words (``plain``: there are none)."""
    if piece.rstrip(_AFTER_STOP)[-1:] not in _STOP_SIGNS:
        return False
    count, units = words_of(piece if plain else _bare(piece))
    return SHORTEST <= count <= LONGEST and len(set(units)) >= 0.55 * len(units)


def is_record(line: str, keys: Counter, ruled: bool) -> bool:
    """A line of data: fields that are dates, numbers, pairs or keyed values, and words that do not come again and again.

    Links and tags that fill half of a line win over its form, as do words repeated within
    it; ``keys`` counts the keys of the text (a record has each once or has other fields),
    in a text with a table's rule (``ruled``) framed lines are rows.
    """
    bare = _bare(line)
    solid = len("".join(line.split()))
    filled = solid - len("".join(bare.split()))
    marks = len(_MARK.findall(bare))
    if filled > (0.75 if marks > 1 else 0.5) * solid:
        return False
    count, units = words_of(bare)
    repeated = 1 - len(set(units)) / len(units) if units else 0.0
    if count >= 4 and repeated > 0.2 and count > 3 * marks:
        return False
    if marks:
        return count <= 3 * marks or (repeated <= 0.1 and count <= 20 * marks)
    numbers = len(_NUMBER.findall(bare))
    if numbers > 1 and numbers >= count:
        return True
    if ruled and line.lstrip().startswith("|"):
        return True
    key = _KEY.match(line)
    if not key:
        return False
    return key[1] is None or (count <= 6 and (keys[key[1]] == 1 or 2 * keys[key[1]] <= sum(keys.values()) * (1 if numbers else 0.8)))


def _listed(line: str, before: int) -> int:
    """Links and tags fill the line, or it is the short text to one of them; else the rest."""
    bare = _bare(line)
    solid = len("".join(line.split()))
    if solid - len("".join(bare.split())) >= 0.5 * solid or (before == TAGS and words_of(bare)[0] <= 4):
        return TAGS
    return REST


def _cut(line: str) -> list[str]:
    """The line's pieces, each up to its stop."""
    at, out = 0, []
    for end in (_END_ASCII if line.isascii() else _END).finditer(line):
        # "1." before an item is no stop
        if end.start() - at < 4 and _NUMBERED.search(line, at, end.start()):
            continue
        out.append(line[at : end.end()])
        at = end.end()
    if line[at:].strip():
        out.append(line[at:])
    return out


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """The text's lines by kind; a line of sentences and others gives both."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    ruled = "|" in text and _RULE.search(text) is not None
    lines = [line for line in text.splitlines() if line.strip()]
    keys = Counter(m[1] for line in lines if ": " in line and (m := _KEY.match(line)) and m[1])
    before = SENTENCES
    for line in lines:
        pieces = _cut(line)
        plain = _SIGN.search(line) is None
        kinds = [is_sentence(p, plain) for p in pieces]
        if not any(kinds):
            before = RECORDS if is_record(line, keys, ruled) else _listed(line, before)
            yield before, line
            continue
        before = SENTENCES
        if len(pieces) > 3 and (len(line.split()) if line.isascii() else words_of(line)[0]) < (SHORTEST + 0.5) * len(pieces):
            yield FRAGMENTS, line
            continue
        short: list[str] = []
        loose = 0
        for sentence, piece in zip(kinds, pieces, strict=True):
            if not sentence and len(piece) > 40:
                yield _listed(piece, before), piece
                continue
            short.append(piece.strip())
            loose += 0 if sentence else len(piece)
        left = " ".join(short)
        yield (FRAGMENTS if loose > 0.5 * len(left) else SENTENCES), left


def blocks(text: str) -> list[tuple[int, str]]:
    """Neighbouring segments of one kind put together, up to ``BLOCK`` characters each."""
    out: list[tuple[int, list[str], int]] = []
    for kind, piece in _segments(text):
        for begin in range(0, len(piece), BLOCK):
            part = piece[begin : begin + BLOCK].strip()
            if out and out[-1][0] == kind and out[-1][2] + len(part) < BLOCK:
                out[-1][1].append(part)
                out[-1] = (kind, out[-1][1], out[-1][2] + len(part) + 1)
            else:
                out.append((kind, [part], len(part)))
    return [(kind, ("\n" if kind in (RECORDS, REST) else " ").join(parts)) for kind, parts, _ in out]


def _skeleton(text: str) -> str:
    """The text with every link, ticker, hashtag, word and number replaced by one sign each."""

    def sign(m: re.Match) -> str:
        if m[6]:
            return "\n" if "\n" in m[6] else " "
        return "LTHw9"[m.lastindex - 1]

    return _TOKEN.sub(sign, text)


def _items(block: str) -> tuple[float, float]:
    """Of a block without sentences: the words per item of its list, and the share of different words."""
    bare = _bare(block)
    items = [n for n in (words_of(x)[0] for x in _ITEMS.split(bare)) if n]
    units = words_of(bare)[1]
    return sum(items) / max(1, len(items)), len(set(units)) / max(1, len(units))


def measure(text: str) -> list[dict]:
    """What each block of the text measures; only what its kind needs."""
    found = []
    for kind, block in blocks(text):
        raw = block.lower().encode("utf-8", "replace")
        size = max(1, len(raw))
        words, skeleton, distinct = 0.0, 1.0, 1.0
        if kind in (REST, TAGS):
            skeleton = len(zlib.compress(_skeleton(block).encode("utf-8", "replace"), 6)) / size
        if kind == REST:
            words, distinct = _items(block)
        elif kind == SENTENCES:
            pieces = _cut(block)
            distinct = len(set(pieces)) / len(pieces)
        found.append({
            "kind": kind, "chars": len(block), "script": script_of(block), "bin": int(math.log2(size)), "raw": len(zlib.compress(raw, 6)) / size if kind != RECORDS else 1.0,
            "skeleton": skeleton, "distinct": distinct, "words": words,
        })
    return found


_BLOCKS = "array<struct<kind:int,chars:int,script:int,bin:int,raw:double,skeleton:double,distinct:double,words:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("chars", pa.int32()), ("script", pa.int32()), ("bin", pa.int32()), ("raw", pa.float64()), ("skeleton", pa.float64()), ("distinct", pa.float64()), ("words", pa.float64())]))


def measured(documents: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:  # noqa: A002
    """(id, lang, blocks): one row per document, whole texts, no shuffle; null and empty texts have no blocks.

    ``lang`` becomes the first two letters of the language's code, empty without a column or a code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([measure(t) if t else [] for t in part.column(2).to_pylist()], _ARROW)], [id, "lang", "blocks"])

    kind = documents.schema[id].dataType.simpleString()
    code = F.coalesce(F.regexp_extract(F.lower(F.col(f"`{lang}`").cast("string")), "^([a-z]{2})", 1), F.lit("")) if lang else F.lit("")
    return documents.select(F.col(f"`{id}`").alias(id), code.alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"`{id}` {kind}, lang string, blocks {_BLOCKS}")


def _usual(bin_: int) -> float:
    """What prose of about 2**bin bytes compresses to, before the corpus has been seen."""
    return 0.35 + 5 / math.sqrt(1.5 * 2**bin_)


def expected(features: DataFrame, weight: int = 20, least: int = 200) -> dict[tuple[int, str, int], float]:
    """Mean compression ratio of sentences by script, language and length class, over the whole corpus.

    The prior of :func:`_usual` counts as ``weight`` blocks of a script, a script's mean as
    ``weight`` blocks of a language of it; languages with fewer than ``least`` blocks in a
    class go by their script. A block has at most 4 bytes for each of its ``BLOCK``
    characters and a language two letters, so at most 11 x 14 x 677 means can reach the
    driver, and as many times ``least`` blocks must be there for it.
    """
    blocks_ = features.select("lang", F.explode("blocks").alias("b")).where(F.col("b.kind") == SENTENCES).groupBy("b.script", "lang", "b.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("b.raw").alias("raw"))
    per = blocks_.groupBy("script", "bin").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.collect_list(F.when((F.col("n") >= least) & (F.col("lang") != ""), F.struct("lang", "n", "raw"))).alias("langs"))
    means = {(script, "", bin_): _usual(bin_) for script in range(len(SCRIPTS)) for bin_ in range(14)}
    for r in per.collect():
        mean = (r["raw"] + weight * _usual(r["bin"])) / (r["n"] + weight)
        means[r["script"], "", r["bin"]] = mean
        for one in r["langs"]:
            means[r["script"], one["lang"], r["bin"]] = (one["raw"] + weight * mean) / (one["n"] + weight)
    return means


def stuffed_pages(documents: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str | None = None, share: float = 0.7, extreme: float = 0.35, redundant: float = 0.65, listed: float = 0.75, shapeless: float = 0.35, least_bin: int = 7, least_chars: int = 50) -> DataFrame:  # noqa: A002
    """Documents that are mostly repeated keywords, links or tags: (id, stuffed_share).

    Texts are cut into blocks of sentences, of fragments with stops, of data, of links and
    tags, and of the rest; what a sentence is goes by the density of sentence punctuation
    and the variety of words in any script, not by a language's words. Each block's
    compression ratio is set against that of sentences of its script, language (``lang``,
    a column with codes, if given) and length class over the whole corpus. Stuffed is

    - a block without sentence punctuation that is redundant: its ratio is at most
      ``listed`` of the usual; or that of its skeleton (each link, tag, word and number one
      sign) at most ``shapeless`` of it while its items are keywords (4.5 words on average,
      or 6.5 if it also compresses better than sentences do);
    - a block of links and tags whose skeleton is as redundant;
    - a block of fragments (fewer words to a stop than sentences have) at most ``redundant`` of the usual;
    - a block of sentences at most ``extreme`` of the usual, hardly any of them different.

    Blocks under 2**``least_bin`` bytes compress too little to tell and go by their items, those
    under four times that also by their repeated words. Lines of data (:func:`is_record`) are never stuffed; the form alone does
    not make one. A page counts with a stuffed share of its characters of at least ``share``
    and at least ``least_chars`` stuffed characters (less is a short note). One pass over the
    texts; its measures (some numbers per block) are checkpointed, and a small table of means
    goes to the driver (:func:`expected`).

    Defined cases: null, empty and blank texts are no cases; every row is judged by
    itself, repeated and null ids too; extra columns are ignored.
    """
    features = cut_lineage(measured(documents, id=id, text=text, lang=lang))
    means = expected(features)
    table = F.map_from_arrays(F.array(*(F.lit(f"{script} {code} {bin_}") for script, code, bin_ in means)), F.array(*(F.lit(raw) for raw in means.values())))

    def usual(b: Column) -> Column:
        of = lambda code: F.element_at("usual", F.concat_ws(" ", b["script"].cast("string"), code, b["bin"].cast("string")))
        return F.coalesce(of(F.col("lang")), of(F.lit("")))

    def stuffed(b: Column) -> Column:
        raw, bare = b["raw"] / usual(b), b["skeleton"] <= shapeless * usual(b)
        short = b["bin"] < least_bin
        keywords = ((b["bin"] <= least_bin + 1) & (b["distinct"] <= 0.5)) | F.when(short, b["words"] <= 4.5).otherwise((raw <= listed) | (bare & ((b["words"] <= 4.5) | ((b["words"] <= 6.5) & (raw <= 0.95)))))
        return (
            F.when(b["kind"] == REST, keywords).when(b["kind"] == TAGS, short | bare)
            .when(b["kind"] == FRAGMENTS, ~short & (raw <= redundant)).when(b["kind"] == SENTENCES, ~short & (raw <= extreme) & (b["distinct"] <= 0.25)).otherwise(False)
        )

    judged = F.transform("blocks", lambda b: F.struct(b["chars"].alias("chars"), stuffed(b).alias("stuffed")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda s, b: s + b[f])
    hit = F.filter("judged", lambda b: b["stuffed"])
    scored = features.withColumn("usual", table).select(id, judged.alias("judged")).select(id, (total(hit, "chars") / F.greatest(total(F.col("judged"), "chars"), F.lit(1))).alias("stuffed_share"), total(hit, "chars").alias("chars"))
    return scored.where((F.col("stuffed_share") >= share) & (F.col("chars") >= least_chars)).select(id, "stuffed_share")
