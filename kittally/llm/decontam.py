"""Benchmark leaks by template windows: numbers, names and units become typed slots."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kittally.llm.common import id_text, values
from kittally.llm.spans import Rolling
from kittally.session import cut

WINDOW, RUN, BITS, REMEMBERED = 8, 13, 1 << 22, 1 << 19
OPENINGS = (8, 0, 1)  # flags of the word before a text: end of a sentence, plain word, number
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡…"
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*\w{0,3}")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "degree degrees celsius fahrenheit kelvin percent dollar dollars cent cents euro euros pence watt watts volt volts joule joules newton newtons "
    "meter meters metre metres kilometer kilometers kilometre kilometres mph kmh hz khz mhz kb mb gb".split()
)
GLUED = re.compile(r"(\d)(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_KINDS = {1: "number", 2: "name", 3: "unit"}
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(f"<{name}>") >> 4) for k, name in _KINDS.items()}


class _Lexicon(dict):
    """Per word: hash of its plain form above four flag bits (number, capital, unit word, end of sentence)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.strip(MARKS)
        low = core.lower()
        flags = 0
        if NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            flags |= 1
        elif core[:1].isupper() and not core.isupper():  # shouting makes no names
            flags |= 2
        if low in UNITS:
            flags |= 4
        if word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", ";"):
            flags |= 8
        found = self[word] = (xxhash.xxh64_intdigest(low) >> 4 << 4 | flags) if core else 0
        return found


class Template:
    """A text as template tokens; ``kind`` is 0 for plain words, else the type of slot.

    ``opening`` stands for the flags of a word before the text, on which the type of the first word depends.
    """

    def __init__(self, text: str | None, lexicon: _Lexicon, opening: int = 8):
        self.words = GLUED.sub(r"\1 \2", text or "").split()  # 120km is 120 km
        packed = np.fromiter(map(lexicon.__getitem__, self.words), np.uint64, len(self.words))
        solid = packed != 0
        flags = (packed & np.uint64(15)).astype(np.int64)
        before = np.concatenate(([opening], flags[:-1])) if len(flags) else flags
        number = (flags & 1) > 0
        unit = (flags & 4 > 0) & (before & 1 > 0) & ~number
        name = (flags & 2 > 0) & (before & 8 == 0) & ~unit
        kind = np.select([number, name, unit], [1, 2, 3], 0)
        again = np.concatenate(([False], name[1:] & name[:-1])) if len(name) else name
        self.solid = np.flatnonzero(solid)
        self.cores = packed[self.solid] >> np.uint64(4)
        self.at = np.flatnonzero(solid & ~again)  # several names in a row are one slot
        self.kind = kind[self.at]
        self.tokens = packed[self.at] >> np.uint64(4)
        for k, slot in _SLOT.items():
            self.tokens[self.kind == k] = slot

    def windows(self, size: int) -> np.ndarray:
        """Hash of each window of ``size`` tokens; of the whole if there are fewer, none if there are none."""
        n = len(self.tokens)
        return Rolling(self.tokens, 0).of(np.arange(max(1, n - size + 1)), min(n, size)) if n else np.empty(0, np.uint64)

    def slots(self, start: int, size: int) -> list[tuple[str, str]]:
        """Type and value of the slots of a window."""
        return [(kind, value) for _, kind, value in self.placed_slots(start, size)]

    def placed_slots(self, start: int, size: int) -> list[tuple[int, str, str]]:
        """Token number, type and value of the slots of a window."""
        found = []
        for i in range(start, min(start + size, len(self.at))):
            if k := int(self.kind[i]):
                stop = self.at[i + 1] if k == 2 and i + 1 < len(self.at) else self.at[i] + 1
                found.append((i, _KINDS[k], " ".join(w.strip(MARKS) for w in self.words[self.at[i] : stop]).strip()))
        return found

    def plain(self, start: int, size: int) -> str:
        """The window's template as text, to tell equal hashes from equal windows."""
        part = range(start, min(start + size, len(self.at)))
        return " ".join(f"<{_KINDS[int(k)]}>" if (k := self.kind[i]) else self.words[self.at[i]].strip(MARKS).lower() for i in part)


SHAPE = "id long, at long, n long, hash long, template string, form int, slots array<struct<at: long, kind: string, value: string>>"


def template_windows(
    rows: DataFrame, window: int, bits: np.ndarray | None = None, openings: tuple[int, ...] = (8,), plain: tuple[list[int], np.ndarray] | None = None
) -> DataFrame:
    """Windows of rows (doc_id, text) under SHAPE; with ``bits`` only those whose bit is set.

    ``plain`` adds windows of some sizes of words without case and punctuation, as form -1, by bits of their own.

    Each different template that ``openings`` give a text is a form of its own; behind another word than the
    end of a sentence its first letter is a capital, so that the first token can be a name.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    sizes, table = plain or ([], None)
    others = rows.sparkSession.sparkContext.broadcast(table) if plain else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon()
        kind = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            for key, text in values(batch, "doc_id", "text"):
                forms = {}
                for opening in openings:
                    found = Template(text if opening == 8 else (text or "")[:1].upper() + (text or "")[1:], lexicon, opening)
                    forms.setdefault(found.tokens.tobytes(), found)
                for form, found in enumerate(forms.values()):
                    hashes = found.windows(window)
                    which = np.arange(len(hashes)) if shared is None else np.flatnonzero(shared.value[(hashes % np.uint64(BITS)).astype(np.int64)])
                    signed = hashes.view(np.int64)
                    out += [(key, int(i), len(found.at), int(signed[i]), found.plain(i, window), form, found.placed_slots(int(i), window)) for i in which]
                if sizes:
                    out += [(key, 0, size, h, words, -1, []) for size, h, words in plain_of(forms[next(iter(forms))], sizes, others.value)]
            if out:
                slots = pa.array([[{"at": i, "kind": k, "value": v} for i, k, v in r[6]] for r in out], kind)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(list(zip(*out))[:6], types)), slots], ["id", "at", "n", "hash", "template", "form", "slots"])

    return rows.mapInArrow(run, SHAPE)


def _bits(hashes: DataFrame) -> np.ndarray:
    """Table of BITS bits with those of column ``hash`` set; BITS is a power of two, so this is the unsigned remainder."""
    bits = np.zeros(BITS, bool)
    bits[hashes.select(F.pmod("hash", F.lit(BITS)).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    return bits


def plain_of(found: Template, sizes: list[int], bits: np.ndarray | None = None) -> set[tuple[int, int, str]]:
    """(size, hash, words): different windows of some numbers of words, without case and punctuation."""
    seen = set()
    n = len(found.cores)
    for size in sizes:
        if 0 < size <= n:
            hashes = Rolling(found.cores, 0).of(np.arange(n - size + 1), size)
            which = np.arange(len(hashes)) if bits is None else np.flatnonzero(bits[(hashes % np.uint64(BITS)).astype(np.int64)])
            seen |= {(size, int(h), " ".join(found.words[j].strip(MARKS).lower() for j in found.solid[i : i + size])) for i, h in zip(which, hashes.view(np.int64)[which])}
    return seen


def plain_windows(rows: DataFrame, size: int) -> DataFrame:
    """(item_id, size, hash, words): windows of ``size`` plain words of rows (doc_id, text), the whole text where it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon()
        for batch in batches:
            out = []
            for key, text in values(batch, "doc_id", "text"):
                found = Template(text, lexicon)
                out += [(key, *window) for window in plain_of(found, [min(size, len(found.cores))])]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["item_id", "size", "hash", "words"])

    return rows.mapInArrow(run, "item_id long, size long, hash long, words string")


def row_of(key: str, text: str) -> Column:
    """Hash of key and text: rows of one key are told apart, also rows without a key."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"))


def row_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc_id, text) with ``row`` from :func:`row_of`."""
    return docs.select(row_of(key, text).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, tokens, exact_slots): :func:`row_leaks` by key; rows of one key are taken together."""
    rows = row_text(docs, key, text).select("row", "doc_id").distinct()
    found = row_leaks(docs, benchmark, key, text, **options).join(rows, "row")
    return found.groupBy("doc_id", "item_id").agg(F.max("tokens").alias("tokens"), F.max("exact_slots").alias("exact_slots"))


def row_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
              window: int = WINDOW, run: int = RUN, strict: tuple[str, ...] = ("name", "unit")) -> DataFrame:
    """(row, item_id, tokens, exact_slots): documents that hold a passage of a benchmark item's template.

    A passage is a run of following windows that agree with the item's in order, ``run`` or more template
    tokens long (the whole item if it is shorter). Slots must be consistent: one value of the item stands
    for one value of the document, for the types in ``strict``; numbers may change freely. A run in which a
    value contradicts an earlier one is split at those that are not the item's own, so every stretch that
    keeps the item's values and is long enough counts; names at the item's ends may have grown by capitals
    around the passage. Items have a form for each type that the
    word before can give their first one. ``tokens`` is the longest stretch, ``exact_slots`` says that one
    kept all values. Documents only emit windows whose bit is set in a table of BITS bits over the
    benchmark's windows, so the join sees no others. As a name shows by its capital, copies in other letter case have
    other templates: beside these, ``run`` words of an item in order, without case and punctuation, are a leak
    whatever their types, or all words of an item that has fewer. Items shorter than ``window`` match
    documents of their template alone. Null texts have no windows; an empty benchmark gives no leaks.
    """
    rows = row_text(docs, key, text)
    asked, given = id_text(benchmark, item, "text"), rows.select(F.col("row").alias("doc_id"), "text")
    items = cut(template_windows(asked, window, openings=OPENINGS).withColumnsRenamed({"id": "item_id", "at": "item_at", "n": "item_n", "slots": "item_slots"}))
    words = cut(plain_windows(asked, run).distinct())
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())  # at most ``run`` of them
    seen = cut(template_windows(given, window, _bits(items), plain=(sizes, _bits(words))).withColumnRenamed("id", "doc_id"))
    found = seen.where("form >= 0").drop("form")
    verbatim = seen.where("form < 0").select("doc_id", "hash", F.col("template").alias("words")).join(words, ["hash", "words"])
    verbatim = verbatim.groupBy("doc_id", "item_id").agg(F.max("size").alias("tokens"), F.lit(True).alias("exact_slots"))
    pairs = found.join(items, ["hash", "template"]).where("item_n >= least(n, %d)" % window)
    pairs = pairs.withColumn("shift", F.col("at") - F.col("item_at"))
    order = W.partitionBy("doc_id", "item_id", "form", "shift").orderBy("at")
    pairs = pairs.dropDuplicates(["doc_id", "item_id", "form", "shift", "at"]).withColumn("run", F.col("at") - F.row_number().over(order))
    by = ["doc_id", "item_id", "form", "shift", "run"]
    pairs = cut(pairs.select(*by, "item_n", "item_at", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("both")))
    long = pairs.groupBy(*by).agg(F.min("item_at").alias("first"), F.max(F.col("item_at") + F.least("item_n", F.lit(window))).alias("hi"), F.max("item_n").alias("item_n"))
    slots = pairs.select(*by, "item_n", F.explode("both").alias("s"))
    slots = slots.select(*by, "item_n", F.col("s.a.at").alias("p"), F.col("s.a.kind").alias("kind"), F.col("s.a.value").alias("a"), F.col("s.b.value").alias("b"))
    slots = cut(slots.dropDuplicates([*by, "p"]))
    same = W.partitionBy(*by, "kind", "a").orderBy("p")
    torn = slots.where(F.col("kind").isin(*strict)).withColumn("lo", F.lag("p").over(same)).withColumn("was", F.lag("b").over(same))
    grown = (F.col("p") == F.col("item_n") - 1) & F.col("b").startswith(F.concat("was", F.lit(" "))) | (F.col("lo") == 0) & F.col("was").endswith(F.concat(F.lit(" "), "b"))
    clash = F.coalesce((F.col("b") != F.col("was")) & ~grown, F.lit(False))
    torn = torn.withColumn("torn", F.max(clash).over(W.partitionBy(*by))).where("torn and a <> b")
    whole = (F.col("p") == 0) & F.col("b").endswith(F.concat(F.lit(" "), "a")) | (F.col("p") == F.col("item_n") - 1) & F.col("b").startswith(F.concat("a", F.lit(" ")))
    torn = torn.where(~whole).select(*by, "item_n", F.col("p").alias("lo"), F.col("p").alias("hi"), F.lit(None).cast("long").alias("first"))
    ends = torn.unionByName(long.withColumn("lo", F.lit(None).cast("long")))
    earlier = W.partitionBy(*by).orderBy("hi").rowsBetween(W.unboundedPreceding, -1)
    begin = F.greatest(F.max("first").over(W.partitionBy(*by)), F.max("lo").over(earlier) + 1)  # greatest() skips nulls
    stretches = ends.withColumn("begin", begin).withColumn("tokens", F.col("hi") - F.col("begin")).where(F.col("tokens") >= F.least(F.lit(run), "item_n"))
    changed = slots.where("a <> b").select(*(F.col(c).alias(f"_{c}") for c in by), "p")
    inside = functools.reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), by, (F.col("p") >= F.col("begin")) & (F.col("p") < F.col("hi")))
    kept = stretches.join(changed, inside, "left").groupBy(*by, "begin", "hi", "tokens").agg((F.count("p") == 0).alias("exact_slots"))
    kept = kept.select("doc_id", "item_id", "tokens", "exact_slots")
    both = kept.unionByName(verbatim)
    leaked = both.groupBy("doc_id", "item_id").agg(F.max("tokens").alias("tokens"), F.max("exact_slots").alias("exact_slots"))
    return leaked.select(F.col("doc_id").alias("row"), "item_id", "tokens", "exact_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, tokens, row): one row per row of docs, each judged by its own text.

    ``row`` is that of :func:`row_text`, which tells rows of one key apart; rows without a key are judged too.
    """
    found = row_leaks(docs, benchmark, key, text, **options).groupBy("row").agg(F.count("*").alias("n_items"), F.max("tokens").alias("tokens"))
    rows = row_text(docs, key, text).select("row", "doc_id").join(found, "row", "left")
    return rows.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "row"
    )
