"""Schema drift: a lifespan catalogue of fields, the log of its changes, one table.

Lines are parsed to VARIANT and exploded to cells (file, field, type, value) in the
JVM. The catalogue has one row for each producer, field and file; ``lag`` over the
file order finds the islands in which a field lives, whose starts and endings are the
additions and removals. An ending and a start in one file are a rename if the facts
agree: records that both files carry have equal values under both names. Pairs seen to
agree anywhere form the alias table, which settles renames that few records show and
from which the casts of the unified table follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: Columns of the unified table; the fields beyond, by frequency, share one map.
MAX_COLUMNS = 2_000
REST = "other_fields"

_TYPE = (
    "CASE WHEN {t} LIKE 'OBJECT%' THEN 'object' WHEN {t} LIKE 'ARRAY%' THEN 'array' WHEN {t} = 'STRING' THEN 'string' "
    "WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'VOID' THEN 'null' ELSE 'number' END"
)
# Leaf values of a container's JSON text, without the keys of key-value lists.
_LEAVES = r"""regexp_extract_all({j}, '"(?!key")[^"]*":("(?:[^"\\\\]|\\\\.)*"|[-+.0-9eE]+|true|false)', 1)"""


def cells(lines: DataFrame, producer: str, file: str, written: str, line: str, asked: DataFrame | None = None) -> DataFrame:
    """One row for each field of each parseable object line, two levels deep.

    Columns ``producer, file, written, line_no, parent, field, type, value`` (VARIANT)
    and ``record``, the line's ``hash``. Lines that are null, blank, cut off or no
    object give none. Repeated lines repeat their cells. With ``asked`` (``producer, file,
    asks``) only those files are read, and ``asks`` goes along.
    """
    spark = lines.sparkSession
    raw = lines.select(F.col(producer).alias("producer"), F.col(file).alias("file"), F.col(written).alias("written"), "line_no", F.col(line).alias("line"))
    raw = spread(raw) if asked is None else raw.join(asked, ["producer", "file"])
    head = ["producer", "file", "written", "line_no", *([] if asked is None else ["asks"])]
    parsed = raw.select(*head, F.try_parse_json("line").alias("v")).where(F.schema_of_variant("v").like("OBJECT%"))
    top = (
        parsed.withColumn("record", F.try_variant_get("v", "$.hash", "string"))
        .lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        .select(*head, "record", F.col("key").alias("field"), "value", F.schema_of_variant("value").alias("_t"))
    )
    both = (
        top.where("_t LIKE 'OBJECT%'")
        .withColumnRenamed("value", "v")
        .lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        .select(*head, "record", F.col("field").alias("parent"), F.concat("field", F.lit("."), "key").alias("field"), "value", F.schema_of_variant("value").alias("_t"))
    )
    every = top.select(*head, "record", F.lit("").alias("parent"), "field", "value", "_t").unionByName(both)
    return every.withColumn("type", F.expr(_TYPE.format(t="_t"))).drop("_t")


def _comparable(df: DataFrame) -> DataFrame:
    """``fact``: the value in a form that survives retyping; null for JSON null."""
    text = F.try_variant_get("value", "$", "string")
    inner = F.when((F.col("type") == "string") & text.rlike(r"^\s*[\[{]"), F.try_parse_json(text))
    box = F.when(F.col("type").isin("object", "array"), F.to_json("value")).otherwise(F.to_json(inner))
    plain = F.when(F.lower(text).isin("true", "false"), F.when(F.lower(text) == "true", "1.0").otherwise("0.0")).otherwise(
        F.coalesce(
            F.expr("CAST(try_cast(regexp_replace(_x, '^[A-Za-z]+-(?=[0-9]+$)', '') AS DOUBLE) AS STRING)"), F.col("_x")
        )
    )
    leaves = F.expr(
        "concat('[', array_join(array_sort(transform("
        + _LEAVES.format(j="_j")
        + ", x -> coalesce(CAST(try_cast(trim(BOTH '\"' FROM x) AS DOUBLE) AS STRING), trim(BOTH '\"' FROM x)))), '|'), ']')"
    )
    return (
        df.withColumn("_x", text)
        .withColumn("_j", box)
        .withColumn("fact", F.when(F.col("type") == "null", None).when(F.col("_j").isNotNull(), leaves).otherwise(plain))
        .withColumn("boxed", F.col("_j").isNotNull())
        .drop("_x", "_j")
    )


def catalogue(cells: DataFrame) -> DataFrame:
    """Lifespans: one row for each producer, field and file that has the field.

    ``seq`` numbers a producer's files by time written (then by id), ``files`` is
    their number; ``type`` is null if all values are, else the most frequent type;
    ``last_seq`` and ``last_type`` are the field's previous appearance; ``island``
    numbers its uninterrupted stretches.
    """
    kinds = cells.groupBy("producer", "file", "written", "parent", "field", "type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("type") == "null", None).otherwise(F.struct("n", "type"))
    fields = kinds.groupBy("producer", "file", "written", "parent", "field").agg(F.max(rank).alias("_k")).withColumn("type", F.col("_k.type")).drop("_k")
    fields = cut(fields)  # as small as the fields of the files; the lines are parsed once
    order = Window.partitionBy("producer").orderBy("written", "file")
    files = (
        fields.select("producer", "file", "written").distinct()
        .withColumn("seq", F.row_number().over(order))
        .withColumn("last_file", F.lag("file").over(order))
        .withColumn("files", F.count("*").over(Window.partitionBy("producer")))
    )
    life = Window.partitionBy("producer", "field").orderBy("seq")
    joined = fields.join(files.drop("written"), ["producer", "file"])
    return (
        joined.withColumn("last_seq", F.lag("seq").over(life))
        .withColumn("last_type", F.lag("type").over(life))
        .withColumn("next_seq", F.lead("seq").over(life))
        .withColumn("island", F.sum(F.when(F.col("seq") - F.col("last_seq") == 1, 0).otherwise(1)).over(life))
    )


def _edges(cat: DataFrame) -> DataFrame:
    """Starts and endings of islands at the file where they show, nested ones only
    where the parent is an object in both files."""
    starts = cat.where("seq > 1 AND (last_seq IS NULL OR seq - last_seq > 1)").select(
        "producer", "parent", "field", "type", "seq", F.lit("start").alias("edge")
    )
    ends = cat.where("seq < files AND (next_seq IS NULL OR next_seq - seq > 1)").select(
        "producer", "parent", "field", "type", (F.col("seq") + 1).alias("seq"), F.lit("end").alias("edge")
    )
    edges = starts.unionByName(ends)
    held = cat.where("parent = '' AND type = 'object' AND last_type = 'object' AND seq - last_seq = 1").select(
        "producer", F.col("field").alias("parent"), "seq"
    )
    nested = edges.where("parent <> ''").join(held, ["producer", "parent", "seq"], "left_semi")
    return edges.where("parent = ''").unionByName(nested.select(*edges.columns))


def rename_evidence(lines: DataFrame, cat: DataFrame, edges: DataFrame, **names: str) -> DataFrame:
    """Every ending with every start of the same file and parent, and how far the
    values of the records in both files agree. The pairs are those of one file's few
    changed names, never of records; only lines of files with a change are moved, and
    only cells of changed fields leave them."""
    place = ["producer", "seq", "parent"]
    old = edges.where("edge = 'end'").select(*place, F.col("field").alias("old_field"), F.col("type").alias("old_type"))
    new = edges.where("edge = 'start'").select(*place, F.col("field").alias("new_field"), F.col("type").alias("new_type"))
    pairs = old.join(new, place)
    files = cat.select("producer", "seq", "file", "last_file").distinct()
    wanted = edges.join(pairs.select(*place).distinct(), place, "left_semi").join(files, ["producer", "seq"])
    ask = wanted.select("producer", F.when(F.col("edge") == "end", F.col("last_file")).otherwise(F.col("file")).alias("file"), F.struct("parent", "field", "edge", "seq").alias("a"))
    asks = ask.groupBy("producer", "file").agg(F.collect_list("a").alias("asks"))
    here = F.filter("asks", lambda a: (a["field"] == F.col("field")) & (a["parent"] == F.col("parent")))
    cell = cells(lines, **names, asked=asks).where(F.col("record").isNotNull()).withColumn("_a", here).where(F.size("_a") > 0)
    asked = cell.select("producer", "file", "record", "parent", "field", "value", "type", F.explode("_a").alias("_a")).withColumns({"edge": F.col("_a.edge"), "seq": F.col("_a.seq")})
    facts = _comparable(asked).where("fact IS NOT NULL")
    side = lambda e: F.collect_set(F.when(F.col("edge") == e, F.struct("field", "fact")))
    # The names that change in one file are few, so a record's two sets are small.
    shown = (
        facts.groupBy(*place, "record")
        .agg(side("end").alias("was"), side("start").alias("now"))
        .select(*place, F.explode("was").alias("w"), "now")
        .select(*place, "w", F.explode("now").alias("n"))
        .groupBy(*place, F.col("w.field").alias("old_field"), F.col("n.field").alias("new_field"))
        .agg(
            F.count_if(F.col("w.fact") == F.col("n.fact")).alias("agree"),
            F.count_if(F.col("w.fact") != F.col("n.fact")).alias("differ"),
            F.countDistinct(F.when(F.col("w.fact") == F.col("n.fact"), F.col("w.fact"))).alias("values"),
        )
    )
    return pairs.join(shown, [*place, "old_field", "new_field"], "left").fillna(0, ["agree", "differ", "values"])


def alias_table(evidence: DataFrame) -> DataFrame:
    """Names, without their parent, that carried the same facts anywhere: ``a < b``,
    with the distinct values that agreed and the records that did not."""
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    named = evidence.select(leaf("old_field").alias("o"), leaf("new_field").alias("n"), "values", "agree", "differ")
    return named.groupBy(F.least("o", "n").alias("a"), F.greatest("o", "n").alias("b")).agg(
        F.sum("values").alias("alias_values"), F.sum("agree").alias("alias_agree"), F.sum("differ").alias("alias_differ")
    )


def changes(lines: DataFrame, producer: str = "stream_name", file: str = "file_id", written: str = "written_at", line: str = "line_text") -> DataFrame:
    """The log: ``file_id, change_kind, old_field, new_field`` and both types.

    Kinds are added, removed, renamed and retyped, as found between a file and the one
    its producer wrote before; a producer's first file has none. A field that is
    renamed and retyped gives two rows. A field whose values are all null in one of
    the files has no type there and is not retyped. Empty input gives no rows.
    """
    names = {"producer": producer, "file": file, "written": written, "line": line}
    cat = cut(catalogue(cells(lines, **names)))
    edges = cut(_edges(cat))
    evidence = cut(rename_evidence(lines, cat, edges, **names))
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    judged = evidence.withColumn("a", F.least(leaf("old_field"), leaf("new_field"))).withColumn("b", F.greatest(leaf("old_field"), leaf("new_field")))
    judged = judged.join(alias_table(evidence), ["a", "b"], "left")
    known = (F.col("alias_values") >= 3) & (F.col("alias_agree") > 20 * F.col("alias_differ"))
    local = (F.col("agree") > 9 * F.col("differ")) & ((F.col("values") >= 3) | known)
    unseen = (F.col("agree") + F.col("differ") == 0) & known
    place = ["producer", "seq", "parent"]
    rank = [F.when(known, 1).otherwise(0).desc(), F.desc("values"), F.desc("agree"), F.desc("alias_values"), "old_field", "new_field"]
    renamed = (
        judged.where(local | unseen)
        .withColumn("_o", F.row_number().over(Window.partitionBy(*place, "old_field").orderBy(*rank)))
        .withColumn("_n", F.row_number().over(Window.partitionBy(*place, "new_field").orderBy(*rank)))
        .where("_o = 1 AND _n = 1")
        .select(*place, "old_field", "new_field", "old_type", "new_type")
    )
    gone = renamed.select(*place, F.col("old_field").alias("field"), F.lit("end").alias("edge"))
    come = renamed.select(*place, F.col("new_field").alias("field"), F.lit("start").alias("edge"))
    rest = edges.join(gone.unionByName(come), [*place, "field", "edge"], "left_anti")
    start = F.col("edge") == "start"
    single = rest.select(
        "producer", "seq", F.when(start, "added").otherwise("removed").alias("change_kind"),
        F.when(start, "").otherwise(F.col("field")).alias("old_field"), F.when(start, F.col("field")).otherwise("").alias("new_field"),
        F.when(~start, F.col("type")).alias("old_type"), F.when(start, F.col("type")).alias("new_type"),
    )
    moved = renamed.select("producer", "seq", F.lit("renamed").alias("change_kind"), "old_field", "new_field", "old_type", "new_type")
    both = moved.where("old_type <> new_type").withColumn("change_kind", F.lit("retyped"))
    same = cat.where("seq - last_seq = 1 AND type <> last_type").select(
        "producer", "seq", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"),
        F.col("last_type").alias("old_type"), F.col("type").alias("new_type"),
    )
    log = single.unionByName(moved).unionByName(both).unionByName(same)
    files = cat.select("producer", "seq", "file").distinct()
    return log.join(files, ["producer", "seq"]).select(F.col("file").alias("file_id"), "change_kind", "old_field", "new_field", "old_type", "new_type").distinct()


# The members of a container, an object or a list of {"key": name, other: value}, as entries.
_ENTRIES = """coalesce(map_entries(try_variant_get(_b, '$', 'map<string,variant>')),
  CASE WHEN forall(try_variant_get(_b, '$', 'array<map<string,variant>>'), x -> size(x) = 2 AND try_variant_get(x['key'], '$', 'string') IS NOT NULL)
  THEN transform(try_variant_get(_b, '$', 'array<map<string,variant>>'), x -> named_struct('key', try_variant_get(x['key'], '$', 'string'), 'value', map_values(map_filter(x, (k, v) -> k <> 'key'))[0])) END)"""


def _members(lines: DataFrame, **names: str) -> DataFrame:
    """``file, line_no, parent, field, type, boxed, filled, text`` of each field that is not
    null and of each member of the containers among them, told as an object, as a list of
    keys and values, or as the JSON text of either. ``parent`` is the container's field or
    ''; ``boxed`` values are or hold containers, ``filled`` ones have members."""
    top = _comparable(cells(lines, **names).where("parent = '' AND type <> 'null'"))
    text = F.try_variant_get("value", "$", "string")
    box = F.when(F.col("type").isin("object", "array"), F.col("value")).when(F.col("boxed"), F.try_parse_json(text))
    top = top.withColumn("_b", box).withColumn("_e", F.expr(_ENTRIES)).withColumn("filled", F.coalesce(F.size("_e") > 0, F.lit(False)))
    inner = top.where("filled").select("file", "line_no", F.col("field").alias("parent"), F.explode("_e").alias("_m"))
    inner = inner.select("file", "line_no", "parent", F.col("_m.key").alias("field"), F.col("_m.value").alias("value"), F.schema_of_variant("_m.value").alias("_t"))
    inner = _comparable(inner.withColumn("type", F.expr(_TYPE.format(t="_t")))).where("type <> 'null'").withColumn("filled", F.lit(False))
    told = F.when(F.col("type").isin("object", "array"), F.to_json("value")).otherwise(text).alias("text")
    head = ["file", "line_no", "parent", "field", "type", "boxed", "filled"]
    return top.select(*head, told).unionByName(inner.select(*head, told))


def canonical_names(used: list, log: DataFrame) -> dict[tuple[str, str, bool], tuple[str, str]]:
    """(parent, field, is container) -> one (parent, field) for all its aliases: the most
    frequent, ties by name. Members are aliases under one name of their parent.

    ``used`` are counts of ``parent, field, type, boxed``. Solved on the driver. A string
    that holds a container is one only where the field has containers elsewhere.
    """
    box = ("object", "array")
    pairs = sorted(log.where("change_kind = 'renamed'").select("old_field", "new_field", "old_type", "new_type").distinct().collect())
    boxes = {(r.parent, r.field) for r in used if r.type in box}
    boxes |= {("", f) for r in pairs if r.old_type in box or r.new_type in box for f in (r.old_field, r.new_field)}
    count: dict[tuple[str, str, bool], int] = {}
    for r in used:
        k = (r.parent, r.field, r.boxed and (r.parent, r.field) in boxes)
        count[k] = count.get(k, 0) + r.n

    def solve(count: dict, renames: list[tuple]) -> dict:
        root = {k: k for k in count}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in renames:
            if a in root and b in root:
                a, b = find(a), find(b)
                if a != b:
                    keep, lose = sorted((a, b), key=lambda k: (-count[k], k))
                    root[lose] = keep
                    count[keep] += count[lose]
        return {k: find(k) for k in root}

    def renamed(parent: str) -> list[tuple[tuple, tuple]]:
        start = len(parent) + 1 if parent else 0
        under = [r for r in pairs if not parent or (r.old_field.startswith(f"{parent}.") and r.new_field.startswith(f"{parent}."))]
        return [((r.old_field[start:], b), (r.new_field[start:], b)) for r in under for b in [r.old_type in box or r.new_type in box]]

    top = solve({(f, b): n for (p, f, b), n in count.items() if not p}, renamed(""))
    names = {("", f, b): ("", to) for (f, b), (to, _) in top.items()}
    homes: dict[str, list[str]] = {}
    for p in sorted({p for p, _, _ in count if p}):
        if (p, True) in top:  # members of JSON text in a text field stay in it
            homes.setdefault(top[p, True][0], []).append(p)
    for home, parents in homes.items():
        inside: dict[tuple[str, bool], int] = {}
        for (p, f, b), n in count.items():
            if p in parents:
                inside[f, b] = inside.get((f, b), 0) + n
        found = solve(inside, [x for p in parents for x in renamed(p)])
        names |= {(p, f, b): (home, found[f, b][0]) for p, f, b in count if p in parents}
    return names


def unify(lines: DataFrame, producer: str = "stream_name", file: str = "file_id", written: str = "written_at", line: str = "line_text") -> DataFrame:
    """All parseable lines in one table: ``file_id, line_no`` and a column for each field
    and, named ``parent.key``, for each member of a container.

    Renamed fields and members share a column, under the name that the parents share. A
    column holds numbers if numbers prevail among its scalars (booleans and numeric strings
    are cast), booleans likewise, JSON text if it is a container, else text; what a cast
    cannot represent becomes null. Containers told as a list of keys and values or as JSON
    text have the same members. Those without members (empty, or any other list) and those
    two levels deep are JSON text. A scalar and a container under one name have two
    columns, the latter ending in ``_json``; a name that is taken gets ``_`` behind it.
    Repeated line numbers count once. Beyond MAX_COLUMNS columns the less frequent fields are
    text in a map, ``other_fields``. The names of all fields and their renames are solved on
    the driver: they are the schema, not data.
    """
    names = {"producer": producer, "file": file, "written": written, "line": line}
    cell = _members(lines, **names)
    used = cell.groupBy("parent", "field", "type", "boxed", "filled").agg(F.count("*").alias("n")).collect()
    alias = canonical_names(used, changes(lines, **names))
    scalars = {c for (_, _, b), c in alias.items() if not b}
    kept: dict[tuple, tuple] = {}
    number: dict[tuple, dict[str, int]] = {}
    for r in used:
        b = (r.parent, r.field, True) in alias and r.boxed
        if (r.parent, r.field, b) in alias and not (b and r.filled and not r.parent):  # what has members is told by them
            column = kept[r.parent, r.field, r.boxed, r.filled] = (*alias[r.parent, r.field, b], b)
            of = number.setdefault(column, {})
            of["box" if b else r.type] = of.get("box" if b else r.type, 0) + r.n
    taken, title = {"file_id", "line_no", REST}, {}
    for column in sorted(number):
        p, f, b = column
        name = (f"{p}.{f}" if p else f) + ("_json" if b and (p, f) in scalars else "")
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        title[column] = name
    spark = lines.sparkSession
    rows = [(*k, title[c]) for k, c in sorted(kept.items())]
    mapping = spark.createDataFrame(rows or [("", "", False, False, "")], "parent string, field string, boxed boolean, filled boolean, name string")
    named = cell.join(F.broadcast(mapping), ["parent", "field", "boxed", "filled"])
    often = sorted(title.values(), key=lambda t: (-sum(sum(number[c].values()) for c in number if title[c] == t), t))
    columns = sorted(often[:MAX_COLUMNS])
    kind = {title[c]: max(("number", "boolean", "string", "box"), key=lambda k: n.get(k, 0)) for c, n in number.items()}
    line_of = [F.col("file").alias("file_id"), "line_no"]
    wide = named.groupBy(*line_of).pivot("name", columns or [""]).agg(F.max("text"))
    if len(often) > MAX_COLUMNS:
        more = named.where(~F.col("name").isin(columns)).groupBy(*line_of, "name").agg(F.max("text").alias("text"))
        rest = more.groupBy("file_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias(REST))
        wide = wide.join(rest, ["file_id", "line_no"], "left")
    bit = lambda c: F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)
    numeric = lambda c: F.coalesce(c.try_cast("double"), c.try_cast("boolean").cast("double"), F.regexp_extract(c, r"^[A-Za-z]+-([0-9]+)$", 1).try_cast("double"))
    cast = {"number": numeric, "boolean": bit, "string": lambda c: c, "box": lambda c: c}
    return wide.select("file_id", "line_no", *[cast[kind[c]](F.col(f"`{c.replace('`', '``')}`")).alias(c) for c in columns], *([REST] if len(often) > MAX_COLUMNS else []))
