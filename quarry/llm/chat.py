"""Quotation linking for chat formatting, in DataFrame functions only.

Each message is cut into runs of lines of the same quote level (the number of leading ``>``).  Runs at
level 1 and deeper are quoted passages; they are normalised (ASCII lower case, white space runs as one
space) and hashed.  The same is done to what a message says itself: its whole body, its paragraphs and
its lines.  A quoted passage belongs to the first message of its conversation that says it, earlier than
the quoting one.  Of a message's passages those at the lowest quote level, which the answered message said
itself, go before deeper ones, which it quoted; of one level, a passage that matches as a whole goes before
one that matches by its first line.  The message linked by the first such passage is the parent.  Roots and depths come from pointer doubling.

The result is one row a message, without quotes, with its text in role markup and its position: the rows
are sorted by ranges of (conversation, root turn, place in the thread), and numbered over the whole table.  A
thread is read branch by branch: a message is followed by its answers, earlier ones first, each with all of its own.  A conversation of any length needs no task of its own; ``rendered`` joins the
texts of neighbouring messages, at most so many a row.

Defined cases: null and blank texts have an empty body and no quotes; messages with a null conv_id or
turn are formatted but not linked; rows that repeat (conv_id, turn) share a parent, chosen over all of
them, and are put in order by role and body; a passage said by several messages belongs to the first; blank
passages link to nothing; a null role is written as unknown; very long texts are cut into lines in their own
row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import let, lower_ascii, shared_dir, written

PREFIX = r"^[\x20\t]*>[>\x20\t]*"
ATTRIBUTION = r"^[\x20\t]*On .{1,200} wrote:[\x20\t]*$"
_RUNS = "array<struct<level:int,text:string>>"


def lines(text: Column) -> Column:
    """Lines of a text as (level, text without the quote marks)."""
    rows = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.transform(
        rows,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, PREFIX, "").alias("text"),
        ),
    )


def runs(rows: Column) -> Column:
    """Neighbouring lines of the same level, joined; rows are (level, text)."""
    cut = lambda r: F.filter(
        F.sequence(F.lit(0), F.size(r) - 1),
        lambda i: (i == 0) | (F.get(r, i)["level"] != F.get(r, i - 1)["level"]),
    )

    def of_starts(x: Column) -> Column:
        return F.transform(
            x["starts"],
            lambda s, k: F.struct(
                F.get(x["rows"], s)["level"].alias("level"),
                F.array_join(
                    F.transform(
                        F.slice(
                            x["rows"], s + 1, F.coalesce(F.get(x["starts"], k + 1), F.size(x["rows"])) - s
                        ),
                        lambda y: y["text"],
                    ),
                    "\n",
                ).alias("text"),
            ),
        )

    return let(rows, lambda r: let(F.struct(r.alias("rows"), cut(r).alias("starts")), of_starts))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, quotes): quotes as (level, text) in the order of the message."""

    def of_lines(r: Column) -> Column:
        own = F.filter(
            r,
            lambda x, i: (x["level"] == 0)
            & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(r, i + 1)["level"], F.lit(0)) > 0)),
        )
        return F.struct(
            F.regexp_replace(
                F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"^(?:[\x20\t]*\n)+|\s+$", ""
            ).alias("body"),
            F.when(F.exists(r, lambda x: x["level"] > 0), F.filter(runs(r), lambda x: x["level"] > 0))
            .otherwise(F.array().cast(_RUNS))
            .alias("quotes"),
        )

    return messages.select("conv_id", "turn", "role", let(lines(F.col("text")), of_lines).alias("p")).select(
        "conv_id", "turn", "role", "p.*"
    )


def parents(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): at most one row per message, for the linked ones."""
    quoted = rows.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("at", "q"))
    first = F.split("q.text", "\n", 2)[0]
    keys = quoted.select(
        "conv_id",
        "turn",
        "q.level",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("by"), F.col("at"), normal(F.col("q.text")).alias("t")),
                F.struct(F.lit(1).alias("by"), F.col("at"), normal(first).alias("t")),
            )
        ).alias("k"),
    ).select("conv_id", "turn", "level", "k.by", "k.at", F.md5("k.t").alias("h"), "k.t").where("t <> ''").drop("t")
    body = F.col("body")
    said = F.concat(F.array(body), F.split(body, r"\n[\x20\t]*\n"), F.split(body, "\n"))
    talks = keys.select("conv_id").distinct()
    first_said = (
        rows.join(talks, "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(F.array_distinct(F.transform(said, normal))).alias("t"))
        .where("t <> ''")
        .groupBy("conv_id", F.md5("t").alias("h"))
        .agg(F.min("turn").alias("parent"))
    )
    return (
        keys.join(first_said, ["conv_id", "h"])
        .where("parent < turn")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("level", "by", "at", "parent")).alias("m"))
        .select("conv_id", "turn", F.col("m.parent").alias("parent"))
    )


def rooted(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) by pointer doubling; parents come before their children."""
    shared_dir(links.sparkSession)
    at = links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    at = at.checkpoint()
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        new = at.join(up, ["conv_id", "root"], "left").select(
            "conv_id",
            "turn",
            "parent",
            F.coalesce("far", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("far").isNotNull().alias("moved"),
        ).checkpoint()
        if new.where("moved").isEmpty():
            return new.drop("moved")
        at = new.drop("moved")


def threads(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, place): a number that rises along a thread, in the order of the paths of turns from its root.

    A walk around the tree enters and leaves each message.  Steps point to the next one, and how many messages are
    entered from a step on comes from pointer doubling, so that a long chain costs a logarithmic number of rounds
    and no long paths.  Each step is pointed to once, so that no busy message gathers rows.
    """
    kids = numbered(tree.select("conv_id", "parent", "turn"), "conv_id", "parent", "turn")
    after = kids.select("conv_id", "parent", (F.col("position") - 1).alias("position"), F.col("turn").alias("sibling"))
    kids = kids.join(after, ["conv_id", "parent", "position"], "left")
    first = tree.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    roots = tree.select("conv_id", F.col("root").alias("turn")).distinct()

    def step(turn: str, out: bool) -> Column:
        return F.when(F.col(turn).isNotNull(), F.struct(F.col(turn).alias("turn"), F.lit(out).alias("out")))

    enter = tree.select("conv_id", "turn").union(roots).join(first, ["conv_id", "turn"], "left")
    enter = enter.select("conv_id", step("turn", False).alias("at"), F.coalesce(step("child", False), step("turn", True)).alias("next"), F.lit(1).cast("long").alias("n"))
    none = F.lit(0).cast("long").alias("n")
    leave = kids.select("conv_id", step("turn", True).alias("at"), F.coalesce(step("sibling", False), step("parent", True)).alias("next"), none)
    ends = roots.select("conv_id", step("turn", True).alias("at"), F.lit(None).cast(enter.schema["next"].dataType).alias("next"), none)
    walk = enter.union(leave).union(ends).checkpoint()
    while not (live := walk.where("next IS NOT NULL")).isEmpty():
        ahead = walk.select("conv_id", F.col("at").alias("next"), F.col("next").alias("far"), F.col("n").alias("more"))
        moved = live.join(ahead, ["conv_id", "next"]).select("conv_id", "at", F.col("far").alias("next"), (F.col("n") + F.col("more")).alias("n"))
        walk = moved.union(walk.where("next IS NULL")).checkpoint()
    return walk.where("NOT at.out").select("conv_id", "at.turn", (-F.col("n")).alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message, without quotes, in role markup and with its position in the reply order."""
    rows = parsed(messages)
    links = written(parents(rows), "chat-links")
    if links.isEmpty():
        tree = links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
        places = links.select("conv_id", "turn", F.lit(0).cast("long").alias("place"))
    else:
        tree = rooted(links)
        places = threads(tree)
    rows = rows.join(tree, ["conv_id", "turn"], "left").join(places, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n")).alias("formatted"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("place", F.lit(0)).alias("place"),
    )
    return numbered(rows, "conv_id", "root_turn", "place", "turn", "role", "body").drop("place")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position``, their number from 0 in an order; sorted by ranges, not in one task."""
    sorted_ = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "chat-order"
    )
    part = F.shiftright("_m", 33).alias("_p")
    counts = sorted_.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = counts.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_base"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return (
        sorted_.withColumn("_p", F.shiftright("_m", 33))
        .join(F.broadcast(base), "_p")
        .withColumn("position", F.col("_base") + inside)
        .drop("_p", "_m", "_base")
    )


def rendered(rows: DataFrame, most: int = 200) -> DataFrame:
    """(conv_id, part, n_messages, text): conversations in reply order, in texts of at most ``most`` messages."""
    part = F.floor(F.col("position") / most).alias("part")
    texts = F.sort_array(F.collect_list(F.struct("position", "formatted")))  # at most ``most``
    return rows.groupBy("conv_id", part).agg(
        F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(texts, lambda x: x["formatted"]), "").alias("text")
    )


def query(messages: DataFrame) -> DataFrame:
    return conversations(messages)


_SPACE = r"[\x20\x09-\x0D]"
_NORMAL = rf"trim(regexp_replace(translate({{}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+', ' ', 'g'))"
ORACLE_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
ln AS (SELECT uid, i, s[i] AS line FROM (SELECT uid, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT uid, regexp_split_to_array(t, '\r?\n') AS s FROM m))),
lv AS (SELECT uid, i, length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*>[> \t]*', '') AS txt FROM ln),
nx AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY uid ORDER BY i), 0) AS next_level, coalesce(lag(level) OVER (PARTITION BY uid ORDER BY i), -1) AS last_level FROM lv),
own AS (SELECT uid, string_agg(txt, chr(10) ORDER BY i) AS b FROM nx
  WHERE level = 0 AND NOT (regexp_matches(txt, '^[ \t]*On .{{1,200}} wrote:[ \t]*$') AND next_level > 0) GROUP BY uid),
body AS (SELECT uid, conv_id, turn, role, regexp_replace(regexp_replace(coalesce(b, ''), '^([ \t]*\n)+', ''), '{_SPACE}+$', '') AS body FROM m LEFT JOIN own USING (uid)),
rn AS (SELECT *, sum(CASE WHEN level <> last_level THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) AS run FROM nx),
qu AS (SELECT uid, run, any_value(level) AS level, string_agg(txt, chr(10) ORDER BY i) AS q, arg_min(txt, i) AS q1 FROM rn WHERE level > 0 GROUP BY uid, run),
k0 AS (SELECT uid, level, run, 0 AS part, {_NORMAL.format("q")} AS h FROM qu UNION ALL SELECT uid, level, run, 1, {_NORMAL.format("q1")} FROM qu),
keys AS (SELECT conv_id, turn, level, run, part, h FROM k0 JOIN m USING (uid) WHERE h <> ''),
s0 AS (SELECT conv_id, turn, unnest(list_concat([body], list_concat(regexp_split_to_array(body, '\n[ \t]*\n'), string_split(body, chr(10))))) AS x FROM body),
said AS (SELECT conv_id, {_NORMAL.format("x")} AS h, min(turn) AS parent FROM s0 GROUP BY 1, 2),
cand AS (SELECT k.conv_id, k.turn, parent, level, part, run FROM keys k JOIN said USING (conv_id, h) WHERE parent < k.turn),
links AS (SELECT conv_id, turn, parent FROM cand QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, part, run, parent) = 1),
up AS (SELECT conv_id, turn, parent AS root, CAST(1 AS BIGINT) AS depth, [parent, turn] AS path FROM links
  UNION ALL SELECT up.conv_id, up.turn, l.parent, depth + 1, list_prepend(l.parent, path) FROM up JOIN links l ON l.conv_id = up.conv_id AND l.turn = up.root),
tree AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth, arg_max(path, depth) AS path FROM up GROUP BY 1, 2),
nq AS (SELECT uid, count(*) AS n, max(level) AS deepest FROM qu GROUP BY uid),
res AS (SELECT b.conv_id, b.turn, b.role, b.body, concat('<|', coalesce(b.role, 'unknown'), '|>', chr(10), b.body, chr(10)) AS formatted,
  coalesce(n, 0) AS n_quotes, CAST(coalesce(deepest, 0) AS BIGINT) AS max_level, l.parent AS parent_turn, coalesce(tree.root, b.turn) AS root_turn, coalesce(tree.depth, 0) AS depth, coalesce(tree.path, [b.turn]) AS path
  FROM body b LEFT JOIN nq USING (uid) LEFT JOIN links l ON l.conv_id = b.conv_id AND l.turn = b.turn LEFT JOIN tree ON tree.conv_id = b.conv_id AND tree.turn = b.turn)
SELECT * EXCLUDE (path), row_number() OVER (ORDER BY conv_id NULLS FIRST, root_turn NULLS FIRST, path, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position FROM res
"""
