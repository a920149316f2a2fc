"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stanzagraph.llm.common import SALTS, STAGED, Bounded, discard, give_back, partitions_for, pick, salted_join, slices, staged

#: Words of a window, and the share of an item's windows that a document must have.
WIDTH, COVERAGE = 5, 0.8
#: Literal words that a window needs; one of placeholders alone says nothing.
LITERAL = 3
#: Kinds of windows: templates with names, plain forms, and plain forms word for word.
NAMED, PLAIN, EXACT = range(3)
#: Bits of the Bloom filter that every task gets: 64 a probe, between these powers of two (128 kB and 32 MB).
LEAST_BITS, MOST_BITS = 20, 28
#: What gives a hash its places in the filter.
PLACES = np.random.default_rng(8).integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that a task's codes of words may take.
REMEMBERED = 96 << 20
#: Pairs of document and form, and bytes of documents, that are checked in one group on average.
PAIRS_EACH, BYTES_EACH = 4000, 8_000_000
#: Bytes of verdicts up to which every task gets them all; beyond, they are joined.
BROADCAST = 8_000_000
#: Bytes that a verdict takes there.
VERDICT = 100

NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/]*(%|st|nd|rd|th)?$")
NUMBER_UNIT = re.compile(rb"\d[\d.,]*[a-z]{1,3}$")
PLAIN_NUMBER = re.compile(r"\d+(?:st|nd|rd|th|[a-z]{1,3})?$")
NAME = re.compile(r"[^\W\d_][^\W\d_]*(?:['-][^\W\d_]+)*$")
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice double triple".split())
UNITS = frozenset(b"mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kph kmh watt watts volt volts joule joules newton newtons".split())
PUNCTUATION = b"!\"#&'()*,-./:;<=>?@[\\]^_`{|}~"

NUMBER_CODE, UNIT_CODE, NAME_CODE = (np.uint64(4 * x) for x in (1, 2, 3))
FLAGS = np.uint64(3)
ROLLS = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: str) -> str:
    """``text`` in one case, its letters, marks and digits alone."""
    form = text.upper().casefold()
    return form if form.isalnum() else "".join(c for c in form if unicodedata.category(c)[0] in "LMN")


def word_codes(word: bytes) -> tuple[int, int]:
    """A word's code as part of a template and as a plain form.

    The first is 62 bits of a hash or a placeholder's code, and two flags: it may be a name;
    it ends a sentence. The second is 62 bits of the plain form's hash, and in the lowest
    bits 1 for a number or 2 for a unit; it is 0 where no form is left.
    """
    bare = word.strip(PUNCTUATION)
    low = bare.lower()
    text = bare.decode("utf-8", "replace")
    letters = text.isalpha()
    form = text.upper().casefold() if letters else plain(word.decode("utf-8", "replace"))
    lower = text.lower()
    hashed = xxhash.xxh64_intdigest(lower.encode()) & ~3 | 16
    other = hashed if form == lower else xxhash.xxh64_intdigest(form.encode()) & ~3 | 16 if form else 0
    if not letters and (NUMBER.match(low) or NUMBER_UNIT.match(low)) or low in NUMBER_WORDS:
        code = int(NUMBER_CODE)
    elif low in UNITS:
        code = int(UNIT_CODE)
    else:
        code = hashed
        if text[:1].isupper() and not text[1:].isupper() and (letters or NAME.match(text)):
            code |= 1
    if word[-1:] in b".!?:" or not bare:
        code |= 2
    raw = low if letters and form == lower else form.encode()
    if not letters and PLAIN_NUMBER.match(form) or raw in NUMBER_WORDS:
        other |= 1
    elif raw in UNITS:
        other |= 2
    return code, other if form else 0


class Known(dict):
    """Word -> its place in the arrays of both codes."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.named, self.plain, self.held = array("Q"), array("Q"), 0

    def __missing__(self, word: bytes) -> int:
        base = word if word[-1] > 96 else word[:-1]
        if base.isalpha() and base.islower() and base not in NUMBER_WORDS and base not in UNITS and (base is word or word[-1] in b".,;:!?"):
            other = xxhash.xxh64_intdigest(base) & ~3 | 16  # small letters of ASCII, and a mark: what word_codes() gives
            code = other | 2 if word[-1] in b".!?:" else other
        else:
            code, other = word_codes(word)
        at = self[word] = len(self.named)
        self.named.append(code)
        self.plain.append(other)
        self.held += len(word) + 200
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > REMEMBERED:
            self.forget()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.named, np.uint64)[at], np.frombuffer(self.plain, np.uint64)[at]


def with_names(got: np.ndarray) -> np.ndarray:
    starts = np.r_[np.uint64(2), got[:-1]] & np.uint64(2)
    name = (got & np.uint64(1) == 1) & (starts == 0)
    return np.where(name, NAME_CODE, got & ~FLAGS)


def with_plain_forms(got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One code for each word that has a plain form, and those words' places. Only numbers and units are placeholders."""
    at = np.flatnonzero(got)
    got = got[at]
    kind = got & FLAGS
    return np.where(kind == 0, got, kind * NUMBER_CODE), at


def windows(code: np.ndarray, kind: int, width: int) -> np.ndarray:
    n = len(code) - width + 1
    h = np.full(max(0, n), ROLLS[16 + 8 * kind + width], np.uint64)
    for j in range(width if n > 0 else 0):
        h += code[j : j + n] * ROLLS[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bare(word: bytes) -> bytes:
    return word.strip(PUNCTUATION).lower()


def scarce(code: np.ndarray) -> bool:
    """Whether some window has too few literal words; of placeholders alone there must be LITERAL."""
    width = min(WIDTH, len(code))
    literal = code > NAME_CODE
    if not literal.any():
        return len(code) >= LITERAL
    return bool(np.convolve(literal, np.ones(width, int), "valid").min() < min(LITERAL, width))


Pairs = list[tuple[int, int]]


def stretches(found: Pairs, length: float, least: float) -> Iterator[Pairs]:
    """The runs of pairs (place in the text, place in the item), as long as they can be within ``length``, that have at least so many places of the item."""
    first, places = 0, defaultdict(int)
    for last, (p, q) in enumerate(found):
        places[q] += 1
        while found[first][0] < p - length:
            places[found[first][1]] -= 1
            if not places[found[first][1]]:
                del places[found[first][1]]
            first += 1
        if len(places) >= least and (last + 1 == len(found) or found[first][0] < found[last + 1][0] - length):
            yield found[first : last + 1]


def whole(pairs: Pairs, width: int) -> Pairs:
    return pairs


def chain(pairs: Pairs, width: int) -> Pairs:
    """The most pairs that rise in text and item; where they leave a diagonal, their windows share no word."""
    size = 1 + max(q for _, q in pairs)
    tree = [(0, 0, -1)] * (size + 1)  # greatest (pairs, -breaks, last pair) of the places of the item below
    score: list[tuple[int, int, int]] = []
    before: list[int] = []
    on: dict[int, int] = {}
    ready = 0
    for i, (p, q) in enumerate(pairs):
        while pairs[ready][0] <= p - width:
            k = pairs[ready][1] + 1
            while k <= size:
                tree[k] = max(tree[k], score[ready])
                k += k & -k
            ready += 1
        top, k = (0, 0, -1), q - width + 1
        while k > 0:
            top = max(top, tree[k])
            k -= k & -k
        count, breaks, back = top[0] + 1, top[1] - (top[2] >= 0), top[2]
        same = on.get(p - q)
        if same is not None and (score[same][0] + 1, score[same][1]) >= (count, breaks):
            count, breaks, back = score[same][0] + 1, score[same][1], same
        on[p - q] = i
        score.append((count, breaks, i))
        before.append(back)
    at, out = max(score)[2], []
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def diagonals(pairs: Pairs, width: int) -> Pairs:
    """Pairs that give each word of the text and of the item one partner, from the longest diagonals on: parts may change places."""
    by = defaultdict(list)
    for p, q in pairs:
        by[p - q].append((p, q))
    to: dict[int, int] = {}
    back: dict[int, int] = {}
    out = []
    for d in sorted(by, key=lambda d: (-len(by[d]), d)):
        for p, q in by[d]:
            if all(to.get(p + k, q + k) == q + k and back.get(q + k, p + k) == p + k for k in range(width)):
                to.update((p + k, q + k) for k in range(width))
                back.update((q + k, p + k) for k in range(width))
                out.append((p, q))
    return sorted(out)


def consistent(pairs: Pairs, width: int, slots: dict[int, bytes], value: Callable[[int], bytes]) -> Iterator[tuple[int, bool]]:
    """(places, whether values are all the same) of the runs of pairs in which each value of the slots stands for one.

    Counted are places of the item, but no more than there are places of the text.
    """
    places: dict[int, int] = defaultdict(int)
    theirs: dict[int, int] = defaultdict(int)
    given: dict[bytes, dict[bytes, int]] = defaultdict(dict)
    first, several, other, most = 0, 0, 0, (0, False)

    def put(pair: tuple[int, int], by: int) -> None:
        nonlocal several, other
        p, q = pair
        for own, at in ((places, q), (theirs, p)):
            own[at] += by
            if not own[at]:
                del own[at]
        for k in range(width):
            if (slot := slots.get(q + k)) is not None:
                new, held = value(p + k), given[slot]
                old = len(held)
                held[new] = held.get(new, 0) + by
                if not held[new]:
                    del held[new]
                several += (len(held) > 1) - (old > 1)
                other += by * (new != slot)

    for pair in pairs:
        put(pair, 1)
        while several:
            put(pairs[first], -1)
            first += 1
        now = min(len(places), len(theirs)), not other
        if now > most:
            most = now
            yield most


@dataclass
class Form:
    """One way to compare an item: its windows by hash, and the values of its slots by place."""

    kind: int
    width: int
    n: int
    hashes: np.ndarray
    places: np.ndarray
    slots: dict[int, bytes]

    @classmethod
    def of(cls, kind: int, code: np.ndarray, values: list[bytes]) -> Form | None:
        """None where no window has enough literal words."""
        if not len(code):
            return None
        width = min(WIDTH, len(code))
        places = np.flatnonzero(np.convolve(code > NAME_CODE, np.ones(width, int), "valid") >= min(LITERAL, width))
        if not len(places):
            return None
        hashes = windows(code, kind, width)[places]
        order = np.argsort(hashes, kind="stable")
        return cls(kind, width, len(code), hashes[order], places[order], {int(p): values[p] for p in np.flatnonzero(code <= NAME_CODE)} if kind != EXACT else {})

    def row(self) -> tuple:
        return self.kind, self.width, self.n, self.hashes.view(np.int64).tolist(), self.places.tolist(), list(self.slots), list(self.slots.values())

    def matches(self, hashes: np.ndarray) -> Pairs:
        """(place in the text, place in the item) of each shared window, in order."""
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        at = np.flatnonzero(hi > lo)
        return sorted((p, int(q)) for p, a, b in zip(at.tolist(), lo[at].tolist(), hi[at].tolist(), strict=True) for q in self.places[a:b])

    def check(self, hashes: np.ndarray, value: Callable[[int], bytes]) -> tuple[float, bool] | None:
        """(coverage, whether slots are all the same) if a text of these windows and values contains the item.

        Windows count together if they lie within a stretch a quarter longer than the
        item. There a value of the item's slots must always stand for the same value: over
        all pairs of windows, or over one alignment of them. Any run of windows where this
        holds and that has enough of the item will do, whatever stands beside it.
        """
        found, usable, best = self.matches(hashes), len(self.places), None
        if len({q for _, q in found}) < COVERAGE * usable:
            return None
        for stretch in stretches(found, 1.25 * self.n, COVERAGE * usable):
            for align in (whole, chain, diagonals) if self.slots else (whole,):
                if best == (1.0, True):
                    return best
                for count, same in consistent(align(stretch, self.width), self.width, self.slots, value):
                    if count >= COVERAGE * usable and (best is None or (count / usable, same) > best):
                        best = count / usable, same
        return best


def forms_of(text: bytes, known: Known) -> list[Form]:
    """An item's forms: as a template, and in plain forms that neither case nor punctuation changes.

    Which words are names shows only in mixed case and between sentence marks, so the plain
    forms have no names. Of items with punctuation inside words both forms are kept: with
    these words' parts run together, and apart. Items with windows of too few literal words
    are kept by their exact plain forms as well, unless they are but one or two placeholders.
    """
    words = text.split()
    if not words:
        return []
    out = [Form.of(NAMED, with_names(known.of(words)[0]), [bare(w) for w in words])]
    apart = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.decode("utf-8", "replace")).encode().split()
    seen = set()
    for form in (words, apart):
        got = known.of(form)[1]
        code, at = with_plain_forms(got)
        if code.tobytes() not in seen:
            seen.add(code.tobytes())
            out.append(Form.of(PLAIN, code, [plain(form[p].decode("utf-8", "replace")).encode() for p in at]))
            if len(code) and scarce(code):
                out.append(Form.of(EXACT, got[at], []))
    return [f for f in out if f]


class Text:
    """A document's words and their windows of every kind."""

    def __init__(self, raw: bytes, known: Known):
        self.words = raw.split()
        named, plain_codes = known.of(self.words)
        code, self.at = with_plain_forms(plain_codes)
        self.codes = {NAMED: with_names(named), PLAIN: code, EXACT: plain_codes[self.at]}
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def windows(self, kind: int, width: int) -> np.ndarray:
        if (kind, width) not in self.made:
            self.made[kind, width] = windows(self.codes[kind], kind, width)
        return self.made[kind, width]

    def value(self, kind: int) -> Callable[[int], bytes]:
        if kind == NAMED:
            return lambda p: bare(self.words[p])
        return lambda p: plain(self.words[self.at[p]].decode("utf-8", "replace")).encode()


FORM = "item binary, item_id long, form long, kind int, width int, n int, hashes array<long>, places array<int>, slots array<int>, slot_values array<binary>"
VERDICTS = "key binary, n_items int, item_id long, coverage double, kind string"


def as_forms(items: DataFrame) -> DataFrame:
    """FORM rows of the items (item_id, text); an item that stands twice is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        names = ["item", "item_id", "form", "kind", "width", "n", "hashes", "places", "slots", "slot_values"]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for some in slices(batches, 1):
            rows = []
            for item_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                item = xxhash.xxh3_128_digest(f"{item_id}:".encode() + (text or b""))
                for k, form in enumerate(forms_of(text or b"", known)):
                    rows.append((item, item_id, xxhash.xxh3_64_intdigest(item + bytes([k])) >> 1, *form.row()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], schema=schema)
        known.forget()
        give_back()

    return items.distinct().mapInArrow(run, FORM)


def rarest(forms: DataFrame) -> DataFrame:
    """(h, form): windows of each form of which a text that has enough of it has at least one.

    With 80 % of a form's windows a text misses at most 20 %, so any one more than these
    will do; they are those that the fewest forms share, so that a template that very many
    items begin with brings no pairs of texts and items together.
    """
    each = forms.select("form", F.size("places").alias("usable"), F.posexplode("hashes").alias("at", "h"))
    shared = each.groupBy("h").agg(F.count_distinct("form").alias("forms"))
    rank = F.row_number().over(Window.partitionBy("form").orderBy("forms", "h", "at"))
    needed = F.col("usable") - F.ceil(F.lit(COVERAGE) * F.col("usable") - F.lit(1e-9)) + 1
    return each.join(shared, "h").withColumn("rank", rank).filter(F.col("rank") <= needed).select("h", "form").distinct()


def places(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    return h * PLACES[k] >> np.uint64(64 - bits)


def filter_of(probes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits of a place, and a Bloom filter of the probes' hashes.

    Its size follows the probes up to 32 MB; of a larger benchmark it lets more of other windows pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([places(h, bits, k) for k in range(len(PLACES))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    place = F.col("place") + 1
    set_bits = probes.select("h").mapInArrow(run, "place long")
    rows = set_bits.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).collect()
    held = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        held[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return bits, held


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every document, whether it contains a benchmark item, also with other parameters.

    Numbers, names and units become typed placeholders. A document leaks an item if it has
    at least 80 % of the item's 5-word template windows close together, and each value in
    the item's slots always stands for one value there, where each place of the document
    goes with one place of the item. Windows are compared as templates,
    where case and sentence marks tell names, and in plain forms (one case, no punctuation,
    only numbers and units as placeholders), so copies whose case or punctuation was changed
    count too; names replaced in such copies are other words. Returns doc_id, contaminated,
    n_items, item_id (the least leaked), coverage (its largest) and kind (verbatim or
    reparameterised, of the least item; null where nothing leaks), and columns ``carry``.

    1. Items become forms with their windows' hashes; each form's rarest windows are probes.
    2. One pass over the documents finds those with a probe's hash, through a filter of at
       most 32 MB; these go on, with their hashes, one for each different text of a task.
    3. Their hashes are joined with the probes', dealt over SALTS tasks a hash, and each
       pair of text and form that meets is checked: windows, stretches, slots.
    4. Verdicts are joined to the documents by their texts' MD5.

    Null and wordless documents leak nothing; null and wordless items, and items of one or
    two numbers and units alone, are ignored. A template window needs LITERAL literal words;
    items with other windows also count where 80 % of all their windows stand word for word.
    An item with a null id counts, but names no item_id. Items of under 5 words are one
    window. Items that stand twice with one id count once. Very long texts are checked
    whole. Ties: of an item's forms the one with the largest coverage counts, then a verbatim
    one. Repeated rows: each returned. Empty documents: no rows. Empty benchmark: nothing
    leaks. Extra columns are ignored unless carried.
    """
    carry = carry or []
    spark = docs.sparkSession
    names = [f"carry_{i}" for i in range(len(carry))]
    rows = pick(docs, doc_id=doc_id, text=text, **dict(zip(names, carry, strict=True))).withColumn("text", F.col("text").cast("binary")).withColumn("key", F.unhex(F.md5("text")))
    items = pick(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    before = len(STAGED)
    forms = staged(as_forms(items), "forms")
    probes = staged(rarest(forms), "probes")
    bits, held = filter_of(probes, probes.count())
    widths = sorted((r["kind"], r["width"]) for r in forms.select("kind", "width").distinct().collect())  # at most 15
    shared = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, seen = Known(), shared.value, Bounded(REMEMBERED)
        for some in slices(batches, 1):
            out = []
            for key, raw in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                text = Text(raw or b"", known)
                hits = []
                for kind, width in widths:
                    h = text.windows(kind, width)
                    for k in range(len(PLACES)):
                        at = places(h, bits, k)
                        h = h[held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
                    hits.append(h)
                hits = np.unique(np.concatenate(hits)) if hits else []
                if len(hits) and not seen.get(key):
                    seen.keep(key, True)
                    out.append((key, raw, hits.view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.binary(), pa.list_(pa.int64())], strict=True)], names=["key", "text", "hits"])
        known.forget()
        give_back()

    hits = staged(rows.filter("text is not null").select("key", "text").mapInArrow(probe, "key binary, text binary, hits array<long>"), "hits")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    copies = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hits.select("key", F.explode("hits").alias("h")).distinct().withColumn("salt", salt)
    pairs = staged(met.join(copies(probes), ["h", "salt"]).select("key", "form").distinct(), "pairs")
    size = hits.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(partitions_for(spark, pairs.count(), PAIRS_EACH), -(-size // BYTES_EACH))
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group")
    asked = pairs.withColumn("salt", salt).join(copies(forms), ["form", "salt"]).drop("salt").withColumn("group", group)

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        known, made, texts, out = Known(), {}, {}, []
        if right.num_rows:
            texts = dict(zip(left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True))
        by = defaultdict(list)
        for r in right.to_batches():
            for row in r.to_pylist():
                if row["form"] not in made:
                    made[row["form"]] = Form(row["kind"], row["width"], row["n"], np.asarray(row["hashes"], np.int64).view(np.uint64), np.asarray(row["places"], np.int64), dict(zip(row["slots"], row["slot_values"], strict=True)))
                by[row["key"]].append((row["item_id"] is None, row["item_id"] or 0, row["item"], row["form"]))
        for key, own in by.items():
            text, best = Text(texts[key], known), {}
            for form in own:
                f = made[form[3]]
                got = f.check(text.windows(f.kind, f.width), text.value(f.kind))
                if got:
                    best[form[:3]] = max(best.get(form[:3], (0.0, False)), got)
            if best:
                first = min(best)
                out.append((key, len(best), None if first[0] else first[1], max(x for x, _ in best.values()), "verbatim" if best[first][1] else "reparameterised"))
        known.forget()
        give_back()
        types = [pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["key", "n_items", "item_id", "coverage", "kind"])

    verdicts = staged(hits.select("key", "text", group).groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(check, VERDICTS), "verdicts")
    discard(spark, STAGED[before:-1])
    if verdicts.count() * VERDICT <= BROADCAST:
        out = rows.join(F.broadcast(verdicts), "key", "left")
    else:
        out = salted_join(rows, verdicts, "key", ["doc_id", *names])
    out = out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "coverage", "kind", *names)
    return out.toDF(*out.columns[:6], *carry)


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
