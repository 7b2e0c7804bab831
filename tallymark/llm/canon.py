"""Free-entered values mapped to the entries of a reference list.

First a multi-pattern automaton over the normalised names and aliases of the value's
kind finds embedded mentions; of overlapping ones the longest wins, and a mention is
refused if a word beside it would make it another name (a word that many names of the
list share, such as a rank or a part of place names). The rest goes to token-set
similarity: every token of an entry has to be met by a token of the value, equal, an
abbreviation of a shared word, or within a few edits, in any order; run-together and
split spellings are compared without spaces. What is left is reported as unmatched, and
so is a value that means several entries equally (a value outranks an alias, a country
told in the text decides).
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import parts_for
from .lookalike import transducer

#: Entries of the reference list in one automaton; a longer list is taken in blocks.
BLOCK = 50_000
UNMATCHED = -1

# Words around a value that say nothing about which entry it is.
NOISE = frozenset(
    "the a an is are was it its this that of in at by from to for and or on i we you my our answer result label value output final predicted prediction "
    "city town village place location brand company maker manufacturer product job title role position occupation profession name named called "
    "believe think guess would say probably likely maybe perhaps certainly sure high low medium confidence confident based text document "
    "downtown greater metro area region near central inner outer inc incorporated ltd limited llc llp gmbh ag kg co corp corporation company plc sa srl bv nv oy ab "
    "remote onsite hybrid full part time fulltime parttime permanent temporary contract m w d f x h mfd mwd fmx all genders tm r reg registered official "
    "correct best most match mentioned mentions".split()
)
_NORM = regex.compile(r"[^\p{L}\p{N}]+")
_GLUED = regex.compile(r"(?<=\p{L})['’](?=\p{L})")


@lru_cache(maxsize=100_000)
def normalise(text: str) -> str:
    """Look-alikes resolved, no case, no accents, words of letters and digits."""
    seen = transducer().apply(text).replace("™", " ").replace("®", " ").replace("©", " ")
    low = unicodedata.normalize("NFKD", seen.casefold())
    return " ".join(_NORM.sub(" ", "".join(c for c in _GLUED.sub("", low) if not unicodedata.combining(c))).split())


def unwrap(text: str) -> str:
    """The string inside a JSON object of one member, a JSON string, or the text itself."""
    stripped = text.strip()
    if stripped[:1] in "{\"":
        try:
            value = json.loads(stripped)
        except ValueError:
            return text
        if isinstance(value, dict) and len(value) == 1:
            value = next(iter(value.values()))
        if isinstance(value, str):
            return value
    return text


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words;
    ``most + 1`` if there are more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def budget(word: str) -> int:
    """Edits that a word of this length may be off."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def _shortened(word: str, drops: int) -> set[str]:
    out = {word}
    for _ in range(drops):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def abbreviates(short: str, word: str) -> bool:
    """Same first letter, the other letters in order, and shorter by two or dotted away."""
    if not 1 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class _Kind:
    """Some or all entries of one kind. ``shared`` are the words that three names or more of
    the whole list have, whichever of its entries are here."""

    def __init__(self, entries: list[tuple[int, str, list[str] | None, str | None]], shared: frozenset[str]):
        # Name -> (0 for a value or 1 for an alias, entry).
        self.names: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.country: dict[int, frozenset[str]] = {}
        for canon, value, aliases, country in entries:
            self.country[canon] = frozenset(normalise(country or "").split())
            for rank, form in [(0, value), *((1, x) for x in aliases or [])]:
                norm = normalise(form or "")
                if norm and (0, canon) not in self.names[norm] and (rank, canon) not in self.names[norm]:
                    self.names[norm].append((rank, canon))
        self.names = {n: ids for n, ids in self.names.items() if ids}
        self.automaton = ahocorasick.Automaton()
        for norm in self.names:
            self.automaton.add_word(f" {norm} ", norm)
        if self.names:
            self.automaton.make_automaton()
        self.squeezed: dict[str, list[str]] = defaultdict(list)
        self.squeezed_near: dict[str, set[str]] = defaultdict(set)
        for norm in self.names:
            flat = norm.replace(" ", "")
            self.squeezed[flat].append(norm)
            if len(flat) >= 6:
                for d in _shortened(flat, 1):
                    self.squeezed_near[d].add(flat)
        self.shared = shared
        self.tokens = {norm: tuple(norm.split()) for norm in self.names}
        used = Counter(t for ts in self.tokens.values() for t in set(ts))
        # Every word of an entry has to be met, so it is looked up by its rarest one only.
        self.rarest: dict[str, list[str]] = defaultdict(list)
        for norm, ts in self.tokens.items():
            self.rarest[min(ts, key=lambda t: (t in shared, used[t], -len(t), t))].append(norm)
        self.near: dict[str, set[str]] = defaultdict(set)
        for t in {*used, *shared}:
            for d in _shortened(t, budget(t)):
                self.near[d].add(t)
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in sorted(shared):
            self.by_letter[w[0]].append(w)
        self.initials: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for ts in self.tokens.values():
            for run in zip(ts, ts[1:]):
                if run[0] in shared and run[1] in shared:
                    self.initials[run[0][0] + run[1][0]].add(run)
        self.meanings: dict[str, dict[str, float]] = {}

    def meaning(self, token: str) -> dict[str, float]:
        """Words of the list that a token may stand for, and the cost of each."""
        known = self.meanings.get(token)
        if known is None:
            known = {}
            most = budget(token)
            for d in _shortened(token, most):
                for w in self.near.get(d, ()):
                    e = edits(token, w, 2)
                    if e <= max(most, budget(w)) and e <= 2 and (w[0] == token[0] or e <= 1):
                        known[w] = min(known.get(w, 9), float(e))
            if token not in self.shared:
                for w in self.by_letter.get(token[0], ()):
                    if abbreviates(token, w):
                        known[w] = min(known.get(w, 9), 0.25)
                    elif w not in known and len(w) >= 4 and len(token) >= 4 and edits(token, w, 2) <= 2:
                        known[w] = 2.0
            if len(self.meanings) > 200_000:
                self.meanings.clear()
            self.meanings[token] = known
        return known

    def _named(self, norm: str, words: frozenset[str]) -> list[tuple[float, int]]:
        """Entries of a name, values before aliases, then those whose country the text tells."""
        return [(rank + (0.0 if self.country[c] and self.country[c] <= words else 0.5), c) for rank, c in self.names[norm]]

    def named(self, norm: str) -> list[Found]:
        words = frozenset(norm.split())
        return [Found(NAMED, 0, 0, cost, c, True) for cost, c in (self._named(norm, words) if norm in self.names else ())]

    def mentions(self, norm: str) -> list[Found]:
        """Every name inside the text; ``ok`` unless a word beside it makes it another name."""
        out, text = [], f" {norm} "
        for end, name in self.automaton.iter(text) if self.names else ():
            start = end - len(name) - 1
            rest = text[: start + 1].split() + text[end:].split()
            ok = not any(t in self.shared or (t not in NOISE and len(t) > 1 and self._shared_abbreviation(t)) for t in rest)
            out += [Found(MENTION, start, end, cost, c, ok) for cost, c in self._named(name, frozenset(rest))]
        return out

    def _shared_abbreviation(self, token: str) -> bool:
        return token.isalpha() and any(w in self.shared and c <= 1 for w, c in self.meaning(token).items())

    def run_together(self, norm: str, countries: frozenset[str]) -> list[Found]:
        """Names spelt without or with other spaces: as they are, or one edit off."""
        base, words, out = _words(norm), frozenset(norm.split()), []
        for i, kept in enumerate((base, [t for t in base if t not in NOISE and t not in countries])):
            flat = "".join(kept)
            out += [Found(FLAT + 2 * i, 0, 0, cost, c, True) for n in self.squeezed.get(flat, ()) for cost, c in self._named(n, words)]
            if len(flat) >= 6:
                close = {f for d in _shortened(flat, 1) for f in self.squeezed_near.get(d, ()) if edits(flat, f, 1) <= 1}
                out += [Found(FLAT + 2 * i + 1, 0, 0, 0.0, c, True) for c in sorted({c for f in close for n in self.squeezed[f] for _, c in self.names[n]})]
        return out

    def similar(self, norm: str, countries: frozenset[str]) -> list[Found]:
        """The entries of least cost by token-set similarity; two of them stand for more."""
        base = _words(norm)
        variants = [base]
        for i, t in enumerate(base):
            if t not in self.shared:
                variants += [[*base[:i], *run, *base[i + 1 :]] for run in sorted(self.initials.get(t, ()))]
        for i in range(len(base) - 1):
            variants.append([*base[:i], base[i] + base[i + 1], *base[i + 2 :]])
        best: dict[int, float] = {}
        for tokens in variants:
            self._align(tokens, countries, best, 0.0 if tokens is base else 0.1)
        low = min(best.values(), default=0.0)
        return [Found(SIMILAR, 0, 0, v, c, True) for c, v in sorted(best.items()) if v <= low + 1e-9][:2]

    def _align(self, tokens: list[str], countries: frozenset[str], best: dict[int, float], base_cost: float) -> None:
        meanings = [self.meaning(t) for t in tokens]
        met = {w for m in meanings for w in m}
        for norm in {n for w in met for n in self.rarest.get(w, ())}:
            entry = self.tokens[norm]
            if not met.issuperset(entry):
                continue
            free, cost = list(range(len(tokens))), base_cost
            for w in sorted(entry, key=len, reverse=True):
                options = [(meanings[i][w], i) for i in free if w in meanings[i]]
                if not options:
                    break
                c, i = min(options)
                cost += c
                free.remove(i)
            else:
                if all(self._idle(tokens[i], countries) for i in free) and cost <= 1 + 0.12 * len(norm):
                    for _, canon in self.names[norm]:
                        best[canon] = min(best.get(canon, 99.0), cost)

    def _idle(self, token: str, countries: frozenset[str]) -> bool:
        return token not in self.shared and (token in NOISE or token in countries or token.isdigit() or len(token) == 1)


def _words(norm: str) -> list[str]:
    return [t for t in norm.split() if not t.isdigit()]


class Found(NamedTuple):
    """What some entries say of a text."""

    stage: int
    start: int
    end: int
    cost: float
    canon: int
    ok: bool


#: Stages of the evidence, in the order in which they settle a text.
NAMED, MENTION, OTHER, FLAT, SIMILAR = 0, 1, 2, 3, 7


def settle(found: Callable[[int], list[Found]]) -> tuple[int, list[int]]:
    """(entry or UNMATCHED, entries that tie) from the evidence of all blocks of the list."""

    def single(rows: Iterable[Found]) -> tuple[int, list[int]]:
        best: dict[int, float] = {}
        for r in rows:
            best[r.canon] = min(best.get(r.canon, 99.0), r.cost)
        low = min(best.values())
        ids = sorted(c for c, v in best.items() if v <= low + 1e-9)
        return (ids[0], []) if len(ids) == 1 else (UNMATCHED, ids)

    if rows := found(NAMED):
        return single(rows)
    rows = found(MENTION)
    chosen: list[tuple[int, int]] = []
    for span in sorted({(r.start, r.end) for r in rows}, key=lambda s: (s[0] - s[1], s[0])):
        if all(span[1] <= c[0] + 1 or span[0] >= c[1] - 1 for c in chosen):
            chosen.append(span)
    for span in chosen:
        mine = [r for r in rows if (r.start, r.end) == span]
        if all(r.ok for r in mine):
            return single(mine)
    if found(OTHER):
        return UNMATCHED, []
    for stage in range(FLAT, SIMILAR):
        if rows := found(stage):
            best = single(rows)
            if best[0] != UNMATCHED or (stage - FLAT) % 2 == 0:
                return best
    rows = found(SIMILAR)
    return single(rows) if rows else (UNMATCHED, [])


class CanonMatcher:
    """``match(kind, text)`` is the id of the entry that the text means, or UNMATCHED.

    ``shared`` words of each kind and ``countries`` are those of the entries given unless
    told: a block of a longer list needs the whole list's.
    """

    def __init__(self, entries: Iterable[tuple], shared: dict[str, frozenset[str]] | None = None, countries: frozenset[str] | None = None):
        entries = list(entries)
        by_kind: dict[str, list[tuple]] = defaultdict(list)
        for canon, kind, value, aliases, country in entries:
            by_kind[kind].append((canon, value, aliases, country))
        if shared is None:
            shared = {k: shared_words(x for _, v, a, _ in rows for x in [v, *(a or [])]) for k, rows in by_kind.items()}
        self.kinds = {k: _Kind(rows, shared.get(k, frozenset())) for k, rows in by_kind.items()}
        self.countries = frozenset(w for e in entries for w in normalise(e[4] or "").split()) if countries is None else countries
        self.memo: dict[tuple[str, str], tuple[int, list[int]]] = {}

    def evidence(self, kind: str, norm: str, stage: int) -> list[Found]:
        own = self.kinds.get(kind)
        if stage == OTHER:
            core = " ".join(t for t in norm.split() if t not in NOISE)
            return [Found(OTHER, 0, 0, 0.0, UNMATCHED, True)] if any(core in o.names or norm in o.names for k, o in self.kinds.items() if k != kind) else []
        if own is None:
            return []
        if stage == NAMED:
            return own.named(norm)
        if stage == MENTION:
            return own.mentions(norm)
        if stage == SIMILAR:
            return own.similar(norm, self.countries)
        return [f for f in own.run_together(norm, self.countries) if f.stage == stage]

    def match_or_ties(self, kind: str, text: str) -> tuple[int, list[int]]:
        """Blank texts and unknown kinds are UNMATCHED, as are texts that mean several
        entries equally; those are told beside it."""
        key = (kind, text)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            norm = normalise(unwrap(text))
            known = self.memo[key] = settle(lambda stage: self.evidence(kind, norm, stage)) if norm else (UNMATCHED, [])
        return known

    def match(self, kind: str, text: str) -> int:
        return self.match_or_ties(kind, text)[0]


def shared_words(names: Iterable[str | None]) -> frozenset[str]:
    """Words of three distinct normalised names or more: they tell names apart only with others."""
    used = Counter(t for norm in {normalise(n) for n in names if n} for t in set(norm.split()))
    return frozenset(t for t, n in used.items() if n >= 3)


def map_to_canon(values: DataFrame, canon: DataFrame, block: int = BLOCK, ties: bool = False) -> DataFrame:
    """Add ``canon_id`` to ``values`` (``kind, text`` and any other columns), and with
    ``ties`` the array ``tied`` of the entries that a text means equally.

    Null and blank texts, texts that mean no entry of their kind and tied ones get
    UNMATCHED. The list is read in blocks of about ``block`` entries, so each automaton has
    a bounded size; the answers do not depend on the blocks. With one block rows do not move.
    """
    rows = canon.select("canon_id", "kind", "value", "aliases", "country")
    columns = [c for c in values.columns if c not in ("canon_id", "tied")]
    values = values.select(*columns)
    entries = [tuple(r) for r in rows.orderBy("canon_id").limit(block + 1).collect()]
    out = _in_blocks(values, rows, block) if len(entries) > block else _match_block(values, entries)
    return out if ties else out.drop("tied")


def _match_block(values: DataFrame, entries: list[tuple]) -> DataFrame:
    columns = values.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields) + ", canon_id bigint, tied array<bigint>"
    kind_at, text_at = columns.index("kind"), columns.index("text")
    shared = values.sparkSession.sparkContext.broadcast((entries, None, None))

    def make():
        match = _matcher(shared).match_or_ties

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [
                (UNMATCHED, []) if t is None or k is None else match(k, t)
                for k, t in zip(batch.column(kind_at).to_pylist(), batch.column(text_at).to_pylist())
            ]
            added = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, "canon_id", "tied"])

        return step

    return map_batches(values, schema, make)


_MATCHERS: dict[str, CanonMatcher] = {}


def _matcher(shared) -> CanonMatcher:
    """One for each worker process and list."""
    key = repr(shared.value)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = CanonMatcher(*shared.value)
    return _MATCHERS[key]


_EVIDENCE = "stage int, start int, end int, cost double, canon bigint, ok boolean"


def _list_words(rows: DataFrame) -> tuple[dict[str, frozenset[str]], frozenset[str]]:
    """Shared words of each kind and words of the countries, of a list in blocks: counted
    where the list lies; words of three names or more reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, value, aliases, country in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                out += [(kind, norm, w) for norm in {normalise(x) for x in [value, *(aliases or [])] if x} for w in set(norm.split())]
                out += [(None, "", w) for w in set(normalise(country or "").split())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], ["kind", "norm", "word"])

    words = rows.select("kind", "value", "aliases", "country").mapInArrow(run, "kind string, norm string, word string").distinct()
    counted = words.groupBy("kind", "word").agg(F.count("*").alias("n")).where("n >= 3 OR kind IS NULL").collect()
    shared: dict[str, set[str]] = defaultdict(set)
    for r in counted:
        shared[r.kind].add(r.word)
    countries = frozenset(shared.pop(None, ()))
    return {k: frozenset(v) for k, v in shared.items()}, countries


def _in_blocks(values: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Every block against all distinct values; their evidence is settled together, as
    that of one block is."""
    blocks = -(-rows.count() // block)
    shared, countries = _list_words(rows)
    texts = values.where("kind IS NOT NULL AND text IS NOT NULL").select("kind", "text").distinct()
    told = None
    for b in range(blocks):
        entries = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == b).orderBy("canon_id").collect()]
        part = _evidence_of(texts, (entries, shared, countries))
        told = part if told is None else told.unionByName(part)
    gathered = told.groupBy("kind", "text").agg(F.collect_list(F.struct("stage", "start", "end", "cost", "canon", "ok")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled = []
            for found in batch.column(2).to_pylist():
                at: dict[int, list[Found]] = defaultdict(list)
                for f in found:
                    at[f["stage"]].append(Found(**f))
                settled.append(settle(lambda stage, at=at: at.get(stage, [])))
            added = [pa.array([f[0] for f in settled], pa.int64()), pa.array([f[1] for f in settled], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *added], ["kind", "text", "canon_id", "tied"])

    best = gathered.mapInArrow(run, "kind string, text string, canon_id bigint, tied array<bigint>")
    joined = values.join(best, ["kind", "text"], "left")
    none = F.array().cast("array<bigint>")
    return joined.select(*values.columns, F.coalesce("canon_id", F.lit(UNMATCHED)).alias("canon_id"), F.coalesce("tied", none).alias("tied"))


def _evidence_of(texts: DataFrame, block: tuple) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            row, out = [], []
            for i, (kind, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                norm = normalise(unwrap(text))
                found = [f for stage in range(SIMILAR + 1) for f in matcher.evidence(kind, norm, stage)] if norm else []
                row += [i] * len(found)
                out += found
            at = pa.array(row, pa.int32())
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.bool_()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([f[i] for f in out], k) for i, k in enumerate(kinds)]], ["kind", "text", *Found._fields])

    return texts.mapInArrow(run, f"kind string, text string, {_EVIDENCE}")


def free_values(records: DataFrame, canon: DataFrame) -> DataFrame:
    """``record_kind, record_id, canon_id`` of every record (``record_kind, record_id, kind,
    text``) whose text is not blank and not itself a value of its kind. A repeated
    record counts once."""
    return map_to_canon(open_values(records, canon), canon).select("record_kind", "record_id", "canon_id")


def open_values(records: DataFrame, canon: DataFrame) -> DataFrame:
    """The records that have to be mapped, each once."""
    n = parts_for(records)
    return (
        records.where(F.col("text").isNotNull())
        .join(canon.select("kind", F.col("value").alias("text")).distinct(), ["kind", "text"], "left_anti")
        .repartition(n, "record_kind", "record_id")
        .dropDuplicates(["record_kind", "record_id"])
        .where(~F.col("text").rlike(r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$"))
    )


def unmatched(records: DataFrame, canon: DataFrame) -> DataFrame:
    """The report: ``kind, text, tied, n`` of the texts of ``free_values`` without an entry;
    ``tied`` are the entries they mean equally, ``n`` the records that hold them."""
    found = map_to_canon(open_values(records, canon), canon, ties=True).where(F.col("canon_id") == UNMATCHED)
    return found.groupBy("kind", "text").agg(F.count("*").alias("n"), F.any_value("tied").alias("tied")).select("kind", "text", "tied", "n")
