"""Linking variant spellings of institution names by metric-space partitioning.

A name is read into a kind (university, hospital for a field, ...), a distinctive core
and a location; kind words may be abbreviated, translated, initials or mistyped. Cores
and cities are points of the Levenshtein metric.

Names with one zip code are compared in its cell; a zip code with many names is
partitioned by pivot cores: a core within its cover of a pivot lives in that cell and, by
the triangle inequality, cores are replicated to the cells of all pivots within cover and
radius, so that two variants meet in the cell where one of them lives. Cover and radius go
by the length of the core. Points without a pivot nearby go on to the next level of pivots.
Inside a cell the radius join is exact, behind a letter-count lower bound.

A spelling without a zip code meets those of its kind that share a piece of the core: of
r + 1 pieces, r edits leave one as it is, moved by r places at most.

Variants with one zip code form components. A spelling without one follows its nearest
variant in its city; without any at its place, the nearest whose place does not
contradict it. Following the pointers gives the class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import cut, parts_for
from .canon import edits, normalise
from .lookalike import transducer

#: Greatest distance of linked spellings, of a core and the pivot of its cell, and of one city.
RADIUS, COVER, CITY_RADIUS = 3, 2, 2
#: Pivots of one level; what they leave uncovered goes to the next level.
PIVOTS = 16_384
#: Spellings of a zip code that are one cell; more are partitioned by pivots.
CELL = 256
#: Members of a cell up to which pairs are compared one by one.
FEW = 12
#: Members of a class that one join task pairs with another such block.
BLOCK = 2_000

# Words for kinds of institutions.
KINDS = {
    "university": "university univ uni universite universidad universitat universita universitet universiteit",
    "polytechnic": "polytechnic poly polytech polytechnikum polytechnique politecnico",
    "laboratory": "laboratories laboratory lab labs laboratoire laboratorium laboratorio",
    "academy": "academy acad academie akademie academia",
    "institute": "institute inst institut instituto istituto",
    "hospital": "hospital hosp hopital klinikum clinic clinique krankenhaus spital ospedale infirmary",
    "college": "college coll col kolleg colegio",
    "foundation": "foundation found fdn stiftung fondation fundacion",
    "centre": "centre center ctr cntr cent zentrum centro",
}
# Words that go with a kind or name its field.
FIELD_WORDS = (
    "sciences sci science technology tech techn technical general gen applied physics phys clinical medicine med polar studies stud cardiology card economics econ soil "
    "nursing agronomy agron linguistics ling marine biology biol public health optics chemistry history law arts music dentistry veterinary engineering mathematics computing "
    "research rsch res"
).split()
GLUE = frozenset("of for the and de del di du des da der la le les von f o a og off fur fuer dem el y et at in".split())
# Words that open a part of an institution.
PARTS = frozenset("department dept departement faculty fac school chair unit division section group office laboratory".split()) - {"laboratory"}
FULL = {"sci": "sciences", "tech": "technology", "techn": "technology", "technical": "technology", "gen": "general", "phys": "physics", "med": "medicine", "stud": "studies", "econ": "economics", "card": "cardiology", "agron": "agronomy", "ling": "linguistics", "biol": "biology", "rsch": "research", "res": "research", "science": "science"}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
_VOCABULARY = sorted({*_KIND_OF, *FIELD_WORDS})
#: Words of four letters that abbreviate nothing.
_FULL_SHORT = [w for w in FIELD_WORDS if len(w) == 4 and w not in FULL]
_FIELDS = ["applied physics", "clinical medicine", "polar studies", "cardiology", "economics", "soil science", "nursing", "agronomy", "linguistics", "marine biology", "public health", "optics"]


def _initials() -> dict[str, tuple[str, str]]:
    """Initials -> (kind, field), built from the kinds and fields; clashes are left out."""
    found: dict[str, set] = defaultdict(set)
    for field in _FIELDS:
        i = "".join(w[0] for w in field.split())
        for form, kind in ((f"c{i}", "college"), (f"f{i}", "foundation"), (f"c{i}r", "centre"), (f"{i}rc", "centre"), (f"{i}h", "hospital")):
            found[form].add((kind, " ".join(sorted(field.split()))))
    for form, value in (("as", ("academy", "sciences")), ("it", ("institute", "technology")), ("gh", ("hospital", "general")), ("u", ("university", "")), ("p", ("polytechnic", "")), ("l", ("laboratory", ""))):
        found[form].add(value)
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}


_INITIALS = _initials()


def _letters(word: str) -> int:
    """The set of its letters; each edit brings in or takes out one at most."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) % 61)
    return out


def _counts(word: str) -> int:
    """Its letters with their number, up to three of each; an edit as in ``_letters``."""
    out = 0
    for c in word:
        bit = 1 << 3 * (ord(c) % 61)
        out |= bit if not out & bit else bit << 1 if not out & bit << 1 else bit << 2
    return out


_CLOSE = [(w, len(w), _counts(w)) for w in _VOCABULARY if len(w) >= 4]
_ASIDE = regex.compile(r"[(\[{][^)\]}]*[)\]}]?")
_LONG_PARTS = [(p, _counts(p)) for p in PARTS if len(p) > 5]


@lru_cache(maxsize=1_000)
def _close(size: int) -> tuple[int, list[tuple[str, int, int]]]:
    """Edits that a token of this length may have, and the words within so many letters."""
    most = 1 if size < 6 else 2 if size < 9 else 3
    return most, [x for x in _CLOSE if abs(x[1] - size) <= most]


@lru_cache(maxsize=200_000)
def _is_part(token: str) -> bool:
    if token in PARTS or len(token) < 6:
        return token in PARTS
    own = _counts(token)
    return any((own & ~m).bit_count() <= 1 and (m & ~own).bit_count() <= 1 and edits(token, p, 1) <= 1 for p, m in _LONG_PARTS)


@lru_cache(maxsize=200_000)
def _known(token: str) -> str | None:
    """The vocabulary word a token stands for: equal, or a few edits off and no other one nearer."""
    if token in _KIND_OF or token in FIELD_WORDS:
        return token
    if len(token) < 4:
        return next((w for w in _FULL_SHORT if len(token) == 3 and edits(token, w, 1) == 1), None)
    most, close = _close(len(token))
    own = _counts(token)
    near = [(w, k) for w, k, m in close if (own & ~m).bit_count() <= most and (m & ~own).bit_count() <= most]
    best = min(((edits(token, w, most), -k, w) for w, k in near), default=(9, 0, ""))
    return best[2] if best[0] <= most and best[0] * 3 <= len(best[2]) + 1 else None


@lru_cache(maxsize=200_000)
def read_name(name: str) -> tuple[str, str, str, bool]:
    """(kind, field, core, core is cut short) of a name as typed; field '' if none is told."""
    seen = _ASIDE.sub(" ", transducer().apply(name))
    readings = []
    for segment in seen.split(","):
        kinds, words, core, cut_short = [], [], [], False
        for raw in segment.split():
            for token in normalise(raw).split():
                word = _known(token)
                if token in GLUE or token.isdigit():
                    continue
                if word is None and _is_part(token):
                    kinds.append("part")
                elif word in _KIND_OF:
                    kinds.append(_KIND_OF[word])
                elif word:
                    words.append(FULL.get(word, word))
                else:
                    core.append(token)
                    cut_short |= raw.endswith(".") and len(token) > 3
        if any(len(t) >= 6 for t in core):  # scraps beside a core are mistyped glue
            core = [t for i, t in enumerate(core) if len(t) > 4 or t in _INITIALS and i in (0, len(core) - 1)]
        readings.append((kinds, words, core, cut_short, segment))
    readings = [r for r in readings if r[0][:1] != ["part"] or len(readings) == 1]
    whole = [r for r in readings if r[0] and r[2]]
    if not whole and len(readings) > 1:
        whole = [tuple(sum((r[i] for r in readings), []) for i in range(3)) + (any(r[3] for r in readings), "")]
    kinds, words, core, cut_short, _ = (whole or readings or [([], [], [], False, "")])[0]
    kind = kinds[0] if kinds else ""
    if "centre" in kinds:
        kind = "centre"
    if not kind and len(core) > 1 and core[-1] in _INITIALS:
        kind, field = _INITIALS[core[-1]]
        return kind, field, "".join(core[:-1]), cut_short
    if not kind and len(core) > 1 and core[0] in _INITIALS:
        kind, field = _INITIALS[core[0]]
        return kind, field, "".join(core[1:]), cut_short
    if not kind and core and len(core[-1]) > 9 and core[-1].endswith("tech"):
        return "institute", "technology", "".join(core)[:-4], False
    if not kind and words == ["technology"]:
        kind = "institute"
    plain = {"university", "polytechnic", "laboratory"}
    field = "" if kind in plain else " ".join(w for w in sorted(set(words)) if w != "research")
    if kind == "academy":
        field = "sciences"
    if kind == "institute":
        field = "technology"
    return kind, field, "".join(core), cut_short


def levenshtein_pairs(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` and ``b`` (code points, padded) by one table for all pairs."""
    n, wide_a, wide_b = len(la), int(la.max(initial=0)), int(lb.max(initial=0))
    row = np.tile(np.arange(wide_b + 1, dtype=np.int16), (n, 1))
    out = np.where(la == 0, lb, 0).astype(np.int16)
    for i in range(1, wide_a + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        change = row[:, :-1] + (a[:, i - 1 : i] != b[:, :wide_b])
        np.minimum(change, row[:, 1:] + 1, out=change)
        for j in range(1, wide_b + 1):
            np.minimum(change[:, j - 1], new[:, j - 1] + 1, out=new[:, j])
        row = new
        done = np.flatnonzero(la == i)
        out[done] = row[done, lb[done]]
    return out


def levenshtein(a: str, b: str) -> int:
    """Of two words; many pairs go through ``Points``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def close_pairs(texts: list[str], at: list[int], radius: int) -> list[tuple[int, int, int]]:
    """(row of ``at``, other row, distance) of all pairs within the radius, of a few texts."""
    masks = [_letters(t) for t in texts]
    out = []
    for i in at:
        for j, t in enumerate(texts):
            if abs(len(t) - len(texts[i])) <= radius and (masks[i] & ~masks[j]).bit_count() <= radius and (masks[j] & ~masks[i]).bit_count() <= radius:
                d = levenshtein(texts[i], t) if i != j else 0
                if d <= radius:
                    out.append((i, j, d))
    return out


class Points:
    """Strings as padded code points, with unary letter counts for a lower bound."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        width = int(self.size.max(initial=1))
        self.code = np.zeros((len(texts), width), dtype=np.uint32)
        self.bag = np.zeros((len(texts), 144), dtype=np.float32)
        for i, t in enumerate(texts):
            codes = [ord(c) for c in t]
            self.code[i, : len(codes)] = codes
            seen: dict[int, int] = {}
            for c in codes:
                k = (c - 97) % 36
                m = seen[k] = seen.get(k, 0) + 1
                if m <= 4:
                    self.bag[i, 4 * k + m - 1] = 1

    def only(self, at: np.ndarray) -> Points:
        out = Points([])
        out.texts, out.size, out.code, out.bag = [self.texts[i] for i in at], self.size[at], self.code[at], self.bag[at]
        return out

    def within(self, at: np.ndarray, other: Points, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of self, row of other, distance) of all pairs within the radius.

        An edit takes at most one letter from the common bag, so pairs that share too
        few letters are out of reach (letters beyond the fourth of a kind are taken as
        shared).
        """
        rows, cols = [], []
        spare = np.maximum(0, self.size - self.bag.sum(1)), np.maximum(0, other.size - other.bag.sum(1))
        for i in range(0, len(at), 512):
            part = at[i : i + 512]
            common = self.bag[part] @ other.bag.T
            common += np.minimum(spare[0][part][:, None], spare[1][None, :])
            longer = np.maximum(self.size[part][:, None], other.size[None, :])
            r, c = np.nonzero(longer - common <= radius + 1e-6)
            rows.append(part[r])
            cols.append(c)
        r, c = np.concatenate(rows or [np.empty(0, int)]), np.concatenate(cols or [np.empty(0, int)])
        d = np.empty(len(r), dtype=np.int16)
        for i in range(0, len(r), 200_000):
            s = slice(i, i + 200_000)
            d[s] = levenshtein_pairs(self.code[r[s]], self.size[r[s]], other.code[c[s]], other.size[c[s]])
        good = d <= radius
        return r[good], c[good], d[good]


def reach(a: int, b: int) -> int:
    """Distance up to which cores of these lengths may be one name."""
    short = min(a, b)
    return 1 if short < 5 else 2 if short < 8 else RADIUS


_SPELLING = "sid bigint, kind string, field string, core string, cut_short boolean, n bigint, zip string, city string"
_NAMES = [c.split()[0] for c in _SPELLING.split(", ")]


def _by_length(size: Column, short: int, middle: int, long: int) -> Column:
    """By the lengths at which ``reach`` changes."""
    return F.when(size < 5, short).when(size < 8, middle).otherwise(long)


def spellings(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with their reading, and the distinct readings with frequency and usual place."""
    schema = "mention_id bigint, name string, kind string, field string, core string, cut_short boolean, zip string, city string"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [read_name(x) for x in batch.column(1).to_pylist()]
            zips = [None if z is None or not z.strip() else z.strip() for z in batch.column(2).to_pylist()]
            cities = [None if not c else normalise(c) or None for c in batch.column(3).to_pylist()]
            columns = [pa.array([r[i] for r in read], pa.string() if i < 3 else pa.bool_()) for i in range(4)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(zips, pa.string()), pa.array(cities, pa.string())], [c.split()[0] for c in schema.split(", ")])

        return step

    named = mentions.select("mention_id", "name", "zip", "city").where(F.col("name").isNotNull())
    read = map_batches(named.repartition(parts_for(named), "mention_id").dropDuplicates(["mention_id"]), schema, make)
    by = ["kind", "field", "core"]
    read = cut(read.where(F.col("name").rlike(r"[^\s\p{Z}]")).withColumn("sid", F.xxhash64(*by)))
    distinct = (
        read.groupBy("sid", *by)
        .agg(F.bool_or("cut_short").alias("cut_short"), F.count("*").alias("n"), F.mode("zip", True).alias("zip"), F.mode("city", True).alias("city"))
    )
    return read, distinct.select(*_NAMES)


def visits(points: DataFrame, pivots: dict[str, list[str]], schema: str) -> DataFrame:
    """A row for each point (``schema``, with ``grp, text, radius, cover``) and pivot of its
    group whose cell it visits, with the distance ``d``; a point out of reach of all pivots
    has one row without a cell. ``covered`` tells a point that lives in one of the cells."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    names = [c.split()[0] for c in schema.split(", ")]
    grp_at, text_at, radius_at, cover_at = (names.index(c) for c in ("grp", "text", "radius", "cover"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Points] = {}
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            radius, cover = (batch.column(i).to_numpy(zero_copy_only=False) for i in (radius_at, cover_at))
            by_group = defaultdict(list)
            for i, g in enumerate(batch.column(grp_at).to_pylist()):
                by_group[g].append(i)
            rows, cells, near, covered = [], [], [], []
            for grp, at in by_group.items():
                if grp not in held:
                    held[grp] = Points(shared.value.get(grp, []))
                own, there = Points([texts[i] for i in at]), held[grp]
                at = np.array(at)
                home = np.zeros(len(at), dtype=bool)
                seen = np.zeros(len(at), dtype=bool)
                found = []
                for reach_ in np.unique(radius[at]):
                    r, c, d = own.within(np.flatnonzero(radius[at] == reach_), there, int(reach_))
                    found.append((r, c, d))
                    seen[r] = True
                    home[r[d <= cover[at][r]]] = True
                for r, c, d in found:
                    rows += at[r].tolist()
                    cells += [there.texts[j] for j in c]
                    near += d.tolist()
                    covered += home[r].tolist()
                lost = np.flatnonzero(~seen)
                rows += at[lost].tolist()
                cells += [None] * len(lost)
                near += [None] * len(lost)
                covered += [False] * len(lost)
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cells, pa.string()), pa.array(near, pa.int32()), pa.array(covered, pa.bool_())], [*names, "cell", "d", "covered"])

    return points.select(*names).mapInArrow(run, schema + ", cell string, d int, covered boolean")


def _apart(texts: list[str], cover: list[int]) -> list[str]:
    """The texts that do not live in the cell of one before them."""
    points = Points(texts)
    near: dict[int, list[int]] = defaultdict(list)
    for i, j, d in zip(*points.within(np.arange(len(texts)), points, max(cover, default=0))):
        if i < j and d <= cover[j]:
            near[int(i)].append(int(j))
    gone: set[int] = set()
    for i in range(len(texts)):
        if i not in gone:
            gone.update(near.get(i, ()))
    return [t for i, t in enumerate(texts) if i not in gone]


def metric_cells(points: DataFrame, schema: str) -> DataFrame:
    """``points`` (``schema``, with ``grp, text, n, radius, cover``) with the ``cell`` of each
    pivot they visit.

    Pivots are chosen among the most frequent texts of a group, PIVOTS in all at a level, less
    those that live in the cell of a more frequent one. A text within
    ``cover`` of a pivot lives in its cell; ``radius`` is how far a text's variants and the
    pivots of their cells may be, so by the triangle inequality two variants meet in the
    cell in which one of them lives. Texts without a home go on to the next level.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    spark = points.sparkSession
    # Catalyst's estimate for joins of checkpoints would be thousands.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest, out = points, None
    while True:
        texts = rest.groupBy("grp", "text").agg(F.sum("n").alias("n"), F.max("cover").alias("cover"))
        often: dict[str, list] = defaultdict(list)
        for row in texts.orderBy(F.desc("n"), "text", "grp").limit(PIVOTS).collect():
            often[row.grp].append(row)
        pivots = {g: _apart([r.text for r in rows], [r.cover for r in rows]) for g, rows in often.items()}
        if not pivots:
            return out if out is not None else points.select(*names, F.lit(None).cast("string").alias("cell"))
        seen = cut(visits(rest.repartition(parts), dict(pivots), schema))
        level = seen.where("cell IS NOT NULL").select(*names, "cell")
        out = level if out is None else out.unionByName(level)
        rest = seen.where("NOT covered").select(*names).distinct()


def places(spelled: DataFrame) -> tuple[DataFrame, bool]:
    """A row for each spelling with a zip code and cell of it: a zip code with more than CELL
    spellings of a kind is partitioned by pivots, a smaller one is one cell. And whether one
    is in several cells."""
    rows = cut(spelled.where("zip IS NOT NULL").select(*_NAMES, F.concat_ws("|", "kind", "zip").alias("grp")))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("_m"))
    large = cut(sizes.where(F.col("_m") > CELL).select("grp"))
    if large.isEmpty():
        return rows.withColumn("cell", F.lit("")), False
    small = rows.join(large, "grp", "left_anti").withColumn("cell", F.lit(""))
    size = F.length("core")
    reach_ = F.when(F.col("cut_short"), RADIUS).otherwise(_by_length(size, 1, 2, RADIUS))
    far = reach_ + _by_length(size + reach_, 0, 1, COVER)
    points = rows.join(large, "grp", "left_semi").select(*rows.columns, F.col("core").alias("text"), far.alias("radius"), _by_length(size, 0, 1, COVER).alias("cover"))
    schema = f"{_SPELLING}, grp string, text string, radius int, cover int"
    return small.unionByName(metric_cells(points, schema).select(*rows.columns, "cell")), True


def _may(a: dict, b: dict, distance: int) -> bool:
    """Whether two cores so far apart may be one name."""
    if distance <= reach(len(a["core"]), len(b["core"])):
        return True
    short, long = (a, b) if len(a["core"]) <= len(b["core"]) else (b, a)
    return short["cut_short"] and len(short["core"]) >= 5 and long["core"].startswith(short["core"])


def _same_field(a: dict, b: dict) -> bool:
    """The same field, or one that tells less of the other."""
    told = set(a["field"].split()), set(b["field"].split())
    return told[0] <= told[1] or told[1] <= told[0]


def _rank(m: dict) -> tuple:
    return (m["field"] == "", m["cut_short"], -m["n"], m["core"], m["sid"])


def _one_zip(cell: list[dict]) -> Iterator[tuple[int, int]]:
    """Each member with the best one of its component of variants; all share a zip code."""
    cell = sorted(cell, key=_rank)
    root = np.arange(len(cell))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(a: int, b: int, e: int) -> None:
        x, y = find(a), find(b)
        if x != y and _may(cell[a], cell[b], e) and _same_field(cell[a], cell[b]):
            root[max(x, y)] = min(x, y)

    def pairs(at: np.ndarray, other: np.ndarray) -> None:
        there = points.only(other)
        for i in range(0, len(at), 4096):
            for s, t, e in zip(*points.within(at[i : i + 4096], there, RADIUS)):
                link(int(s), int(other[t]), int(e))

    if len(cell) <= FEW:
        for a, b, e in close_pairs([m["core"] for m in cell], list(range(len(cell))), RADIUS):
            link(a, b, e)
        for i in range(len(cell)):
            if (x := find(i)) != i:
                yield cell[i]["sid"], cell[x]["sid"]
        return
    points = Points([m["core"] for m in cell])
    everyone = np.arange(len(cell))
    pairs(everyone, everyone[:64])
    lead = np.array([find(i) for i in everyone])
    for x in np.unique(lead):  # pairs of what the first ones leave in different components
        mine = np.flatnonzero(lead == x)
        if len(cell) > 64 and 2 * len(mine) <= len(cell):
            pairs(mine, np.flatnonzero(lead != x))
    for i in everyone:
        x = find(int(i))
        if x != i:
            yield cell[i]["sid"], cell[x]["sid"]


def link_cells(members: DataFrame) -> DataFrame:
    """``sid, target`` from the exact radius joins inside the cells of zip codes: links join
    components."""
    cells = members.select(*_NAMES, "grp", "cell").repartition("grp", "cell").sortWithinPartitions("grp", "cell", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def flush() -> None:
            if len(held) > 1:
                out.extend(_one_zip(held))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["cell"]) != key:
                    flush()
                    held, key = [], (row["grp"], row["cell"])
                if not held or held[-1]["sid"] != row["sid"]:
                    held.append(row)
            yield _links(out)
            out = []
        flush()
        yield _links(out)

    return cells.mapInArrow(run, "sid bigint, target bigint")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["sid", "target"])


@lru_cache(maxsize=1_000)
def _pieces(size: int) -> list[tuple[int, int]]:
    """Where a core of this length is cut: one piece more than edits it may have."""
    parts = reach(size, size) + 1
    at = [i * size // parts for i in range(parts + 1)]
    return list(zip(at, at[1:]))


@lru_cache(maxsize=1_000)
def _windows(size: int) -> list[tuple[str, int, int]]:
    """(mark, start, end): what of a core of this length may be a piece of a variant of it. If
    a piece is the first one without an edit, as many edits as pieces are before it at least,
    and if the last one, after it; so it has moved by no more than those on one side."""
    out = []
    for other in range(max(0, size - RADIUS), size + RADIUS + 1):
        most, grown = reach(other, other), size - other
        if abs(grown) <= reach(size, other):
            for i, (a, b) in enumerate(_pieces(other)):
                low, high = max(0, a - i, a + grown - (most - i)), min(size - (b - a), a + i, a + grown + most - i)
                out += [(f"{other}.{i}.", p, p + b - a) for p in range(low, high + 1)]
    return out


def _marks(core: str, cut_short: bool, asks: bool) -> set[str]:
    """What two variants share one of, if one of them ``asks``."""
    n = len(core)
    if asks:
        out = {mark + core[a:b] for mark, a, b in _windows(n)}
    else:
        out = {f"{n}.{i}.{core[a:b]}" for i, (a, b) in enumerate(_pieces(n))}
    # A core that is cut short by more letters than it may have edits.
    for k in range(reach(n - RADIUS, n) + 1, RADIUS + 1):
        if n - k >= 5:
            out.add(f"{'<>'[asks]}{core[: n - k]}")
    if cut_short:
        out.add(f"{'><'[asks]}{core}")
    return out


def variants(spelled: DataFrame) -> DataFrame:
    """``q_sid, sid, d``: the spellings without a zip code with all of their kind that may be
    one name by their cores; a pair may be there repeatedly."""

    def marked(df: DataFrame, asks: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cores = batch.column(2).to_pylist()
                marks = [_marks(c, s, asks) for c, s in zip(cores, batch.column(3).to_pylist())]
                rows = pa.array([i for i, m in enumerate(marks) for _ in m], pa.int32())
                letters = pa.array([_letters(c) for c in cores], pa.int64())
                picked = [batch.column(i).take(rows) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*picked, letters.take(rows), pa.array([x for m in marks for x in m], pa.string())], ["sid", "kind", "core", "cut_short", "letters", "mark"])

        schema = "sid bigint, kind string, core string, cut_short boolean, letters bigint, mark string"
        return df.select("sid", "kind", "core", "cut_short").mapInArrow(run, schema).select("sid", "core", "cut_short", "letters", F.xxhash64("kind", "mark").alias("mark"))

    asked = marked(spelled.where("zip IS NULL"), True).select("mark", *[F.col(c).alias(f"q_{c}") for c in ("sid", "core", "cut_short", "letters")])
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b))) <= RADIUS
    sizes = F.length("core"), F.length("q_core")
    d = F.levenshtein("core", "q_core", RADIUS)
    prefix = F.when(sizes[1] <= sizes[0], F.col("q_cut_short") & F.col("core").startswith(F.col("q_core"))).otherwise(F.col("cut_short") & F.col("q_core").startswith(F.col("core"))) & (F.least(*sizes) >= 5)
    both = marked(spelled, False).join(asked, "mark").where((F.col("sid") != F.col("q_sid")) & apart("letters", "q_letters") & apart("q_letters", "letters") & (d >= 0) & ((d <= _by_length(F.least(*sizes), 1, 2, RADIUS)) | prefix))
    return both.select("q_sid", "sid", d.alias("d"))


def _without_zip(spelled: DataFrame) -> DataFrame:
    """``sid, target, d``: the spellings without a zip code with their variants in the same
    city, with a zip code or better ranked; if there are none, with those whose place does not
    contradict theirs because one of them has none. Of these, one that is more than an edit
    off counts only if no other institution is in the radius."""
    told = ["sid", "kind", "field", "cut_short", "n", "city", "core"]
    pairs = variants(spelled).join(spelled, "sid").join(spelled.select(*[F.col(c).alias(f"q_{c}") for c in told]), "q_sid")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    a, b = words(F.col("field")), words(F.col("q_field"))
    one_field = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    near_city = F.coalesce(F.levenshtein("city", "q_city", CITY_RADIUS) >= 0, F.lit(False))
    unplaced = F.col("city").isNull() | F.col("q_city").isNull()
    better = F.col("zip").isNotNull() | (F.struct(F.col("q_field") == "", F.col("q_cut_short"), -F.col("q_n"), F.col("q_core"), F.col("q_sid")) > F.struct(F.col("field") == "", F.col("cut_short"), -F.col("n"), F.col("core"), F.col("sid")))
    # One swap of neighbours is two edits of the metric: equal letters, equal length.
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = (F.col("d") <= 1) | ((F.col("d") == 2) & (letters(F.col("core")) == letters(F.col("q_core"))))
    # Few pairs, used twice: written once, as the pieces behind them are Python's.
    alike = cut(pairs.where((F.col("kind") == F.col("q_kind")) & one_field & (near_city | unplaced)).select("q_sid", "sid", "d", "zip", near_city.alias("placed"), better.alias("better"), near.alias("near")))
    seen = alike.groupBy("q_sid").agg(F.bool_or(F.col("placed") & F.col("better")).alias("any"), F.countDistinct(F.when(~F.col("placed"), F.col("zip"))).alias("zips"))
    ok = alike.join(seen, "q_sid").where(F.col("better") & F.when(F.col("any"), F.col("placed")).otherwise(~F.col("placed") & (F.col("near") | (F.col("zips") <= 1))))
    return ok.select(F.col("q_sid").alias("sid"), F.col("sid").alias("target"), "d")


def _unread_kinds(spelled: DataFrame) -> DataFrame:
    """``sid, target, d``: spellings that tell no kind and the one kind and field that has
    the same core at the same place."""
    bare = spelled.where("kind = ''").select("core", *[F.col(c).alias(f"q_{c}") for c in ("sid", "zip", "city")])
    told = spelled.where("kind <> ''")
    both = told.join(bare, "core").where("(zip = q_zip) OR ((zip IS NULL OR q_zip IS NULL) AND city = q_city)")
    one = both.groupBy("q_sid").agg(F.countDistinct("kind", "field").alias("k"), F.max_by("sid", F.struct("n", "sid")).alias("target")).where("k = 1")
    return one.select(F.col("q_sid").alias("sid"), "target", F.lit(0).alias("d"))


def components(edges: DataFrame) -> DataFrame:
    """``sid, class``: the least id of the component of each end of ``edges`` (``sid, target``)."""
    both = cut(edges.select("sid", "target").unionByName(edges.select(F.col("target").alias("sid"), F.col("sid").alias("target"))).distinct())
    label = cut(both.groupBy("sid").agg(F.least(F.min("target"), F.min("sid")).alias("class")))
    while True:
        seen = both.join(label.select(F.col("sid").alias("target"), F.col("class").alias("c")), "target").groupBy("sid").agg(F.min("c").alias("c"))
        low = label.join(seen, "sid").select("sid", "class", F.least("class", "c").alias("low"))
        over = label.select(F.col("sid").alias("low"), F.col("class").alias("next"))
        new = cut(low.join(over, "low").select("sid", F.least("low", "next").alias("class"), (F.least("low", "next") != F.col("class")).alias("moved")))
        label = new.select("sid", "class")
        if not new.where("moved").limit(1).count():
            return label


def classes(spelled: DataFrame) -> DataFrame:
    """``sid, class`` of every spelling.

    Spellings with one zip code are joined to components; one without follows its nearest
    variant at its place (ties: with a zip code, then the better ranked), so that it never
    joins two places. A class is named by one of its spellings.
    """
    spelled = cut(spelled)
    members, split = places(spelled)
    strong = link_cells(members)
    weak = _without_zip(spelled).unionByName(_unread_kinds(spelled))
    order = spelled.select(F.col("sid").alias("target"), F.struct(F.col("zip").isNull().alias("z"), (F.col("field") == "").alias("f"), "cut_short", (-F.col("n")).alias("m"), "core", "sid").alias("rank"))
    pick = weak.join(order, "target").groupBy("sid").agg(F.min_by("target", F.struct("d", "rank")).alias("target"))
    # A zip code in one cell has its components already, each member with the best one of its own.
    lead = components(strong) if split else strong.select("sid", F.col("target").alias("class"))
    up = spelled.select("sid").join(lead, "sid", "left").join(pick, "sid", "left")
    # What stands for its component, and what is in none, follows its nearest.
    up = cut(up.select("sid", F.coalesce(F.when(F.col("class") != F.col("sid"), F.col("class")), "target", "sid").alias("class")))
    while True:  # pointer jumping: doubles the distance followed each time
        over = up.select(F.col("sid").alias("class"), F.col("class").alias("next"))
        jumped = cut(up.join(over, "class").select("sid", F.col("next").alias("class"), (F.col("next") != F.col("class")).alias("moved")))
        up = jumped.select("sid", "class")
        if not jumped.where("moved").limit(1).count():
            return up


def mention_classes(mentions: DataFrame) -> DataFrame:
    """``mention_id, name, class`` of every mention (``mention_id, name, zip, city``) with a
    name that is not null or blank; a repeated mention counts once."""
    read, spelled = spellings(mentions)
    return read.select("mention_id", "name", "sid").join(classes(spelled), "sid").select("mention_id", "name", "class")


def class_pairs(members: DataFrame) -> DataFrame:
    """``mention_a < mention_b`` of one class with different names.

    A class larger than BLOCK is salted: one side is split, the other goes to each part.
    """
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"), F.countDistinct("name").alias("names")).where("names > 1")
    sized = members.join(sizes.drop("names"), "class")
    left = sized.select("class", F.pmod(F.xxhash64("mention_id"), F.col("salts")).alias("salt"), F.col("mention_id").alias("mention_a"), F.col("name").alias("_a"))
    right = sized.select("class", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).alias("salt"), F.col("mention_id").alias("mention_b"), F.col("name").alias("_b"))
    return left.join(right, ["class", "salt"]).where("mention_a < mention_b AND _a <> _b").select("mention_a", "mention_b")
