import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, body string, depth int"


def rows(*talk):
    return [(*t, "clash", 9) for t in talk]


def result(spark, *talk):
    out = chat.conversations(spark.createDataFrame(rows(*talk), SCHEMA))
    return {(r.conv_id, r.turn): r for r in out.collect()}


def test_nested_quotes_link_to_the_messages_that_said_them(spark):
    got = result(
        spark,
        (1, 0, "u", "Hello there.\n\nHow are you?"),
        (1, 1, "a", "> How  ARE you?\nFine, and you?"),
        (1, 2, "u", "On Monday A wrote:\n> > How are you?\n> Fine, and you?\n\nGood."),
        (1, 3, "a", "> Good.\nGreat"),
        (1, 4, "u", "> nobody said this\n> Hello there.\nalone"),
        (2, 0, "u", "> Good.\nother conversation"),
    )
    link = {k: (r.parent_turn, r.root_turn, r.depth) for k, r in got.items()}
    assert link == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (2, 0, 3), (1, 4): (None, 4, 0), (2, 0): (None, 0, 0),
    }
    assert got[1, 2].body == "Good." and got[1, 2].max_level == 2 and got[1, 2].n_quotes == 2
    assert got[1, 1].body == "Fine, and you?" and got[1, 0].body == "Hello there.\n\nHow are you?"


def test_first_sayer_wins_and_whole_passages_go_before_first_lines(spark):
    got = result(
        spark, (1, 0, "u", "same"), (1, 1, "u", "same"), (1, 2, "u", "same\nmore"), (1, 3, "a", "> same\nx"), (1, 4, "a", "> same\n> more\ny")
    )
    assert got[1, 3].parent_turn == 0 and got[1, 4].parent_turn == 2


def test_long_reply_chain(spark):
    talk = [(7, 0, "u", "m0")] + [(7, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 70)]
    got = result(spark, *talk)
    assert {(r.root_turn, r.depth) for r in got.values()} == {(0, i) for i in range(70)}
    order = sorted(got.values(), key=lambda r: (r.root_turn, r.depth, r.turn))
    place = {r.turn: i for i, r in enumerate(order)}
    assert all(place[r.parent_turn] < place[r.turn] for r in got.values() if r.parent_turn is not None)


def test_defined_cases(spark):
    df = spark.createDataFrame(
        rows((1, 0, "u", None), (1, 1, "a", " \n "), (None, 2, "a", "> x"), (1, None, None, "> x\nz"), (1, 3, "a", "> "), (1, 3, "a", "q")), SCHEMA
    )
    out = chat.query(df)
    got = out.collect()
    assert len(got) == 6 and all(r.parent_turn is None for r in got)
    assert [r.body for r in got if r.turn == 0] == [""]
    assert chat.query(df.limit(0)).count() == 0
    assert out.where(F.col("depth") > 0).count() == 0


def test_lowest_quote_level_is_the_parent(spark):
    got = result(
        spark,
        (1, 0, "u", "oldest"),
        (1, 1, "a", "> oldest\nolder"),
        (1, 2, "u", ">> oldest\n> older\nnewer"),
        (1, 3, "a", ">>> oldest\n>> older\n> newer\n> and a line nobody said\nlast"),
        (1, 4, "u", ">> older\n> nobody said this\ndeeper only"),
    )
    assert [(got[1, i].parent_turn, got[1, i].depth) for i in range(5)] == [(None, 0), (0, 1), (1, 2), (2, 3), (1, 2)]


WORDS = "yes no maybe please Thanks again when why the plan ship test MERGE fix review later today".split()


def talk(seed, conversations, turns):
    """Threads in which messages quote earlier ones, with their quotes, at several levels and in parts."""
    rnd, out = random.Random(seed), []
    for c in range(conversations):
        said = []
        for t in range(turns):
            own = "\n".join(" ".join(rnd.choices(WORDS, k=rnd.randint(1, 4))) + f" {rnd.randint(0, 60)}" for _ in range(rnd.randint(1, 3)))
            if rnd.random() < 0.2:
                own = own.replace("\n", "\n\n")
            lines = []
            if said and rnd.random() < 0.75:
                quoted = rnd.choice(said).split("\n")
                quoted = quoted[: rnd.randint(1, len(quoted))]
                if rnd.random() < 0.4:
                    lines.append("On Monday X wrote:")
                lines += [rnd.choice(["> ", ">", " > "]) + x.upper() if rnd.random() < 0.1 else "> " + x for x in quoted]
                if rnd.random() < 0.2:
                    lines.append("> never said by anyone")
            text = "\n".join([*lines, own, ""][: rnd.choice([-1, None])])
            if rnd.random() < 0.1:
                text = text.replace("\n", "\r\n")
            said.append(text.replace("\r\n", "\n").rstrip("\n"))
            out.append((c, t, rnd.choice(["user", "assistant", None]), text))
    return out


def brute(messages):
    """(conv, turn) -> (body, quoted passages, deepest level, parent, root, depth), by plain loops."""
    parsed = {}
    for c, t, _, text in messages:
        own, quotes, last = [], [], 0
        lines = (text or "").replace("\r\n", "\n").split("\n")
        marks = [re.match(r"[ \t]*>[> \t]*", x) for x in lines]
        levels = [m.group().count(">") if m else 0 for m in marks]
        for i, (x, m, n) in enumerate(zip(lines, marks, levels, strict=True)):
            if not n:
                if not (re.fullmatch(r"[ \t]*On .{1,200} wrote:[ \t]*", x) and i + 1 < len(lines) and levels[i + 1]):
                    own.append(x)
            elif n == last:
                quotes[-1][1].append(x[m.end() :])
            else:
                quotes.append((n, [x[m.end() :]]))
            last = n
        while own and not own[0].strip(" \t"):
            own.pop(0)
        parsed[c, t] = ("\n".join(own).rstrip(), quotes)
    normal = lambda x: " ".join(x.lower().split())
    found = {}
    for (c, t), (_, quotes) in parsed.items():
        best = None
        for at, (n, q) in enumerate(quotes):
            for by, passage in enumerate(("\n".join(q), q[0])):
                sayers = []
                for (c2, t2), (body, _) in parsed.items():
                    parts = [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]
                    if c2 == c and normal(passage) and normal(passage) in map(normal, parts):
                        sayers.append(t2)
                if sayers and min(sayers) < t and (best is None or (n, by, at) < best[0]):
                    best = ((n, by, at), min(sayers))
        found[c, t] = best and best[1]
    out = {}
    for (c, t), (body, quotes) in parsed.items():
        root, depth = t, 0
        while found[c, root] is not None:
            root, depth = found[c, root], depth + 1
        out[c, t] = (body, len(quotes), max([n for n, _ in quotes], default=0), found[c, t], root, depth)
    return out


def test_random_threads_match_brute_force(spark):
    messages = talk(11, 30, 25)
    want = brute(messages)
    got = chat.query(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.body, r.n_quotes, r.max_level, r.parent_turn, r.root_turn, r.depth) for r in got} == want
    assert sum(w[3] is not None for w in want.values()) > 300 and max(w[2] for w in want.values()) > 3
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(messages)))
    place = {(r.conv_id, r.turn): r.position for r in order}
    assert all(place[r.conv_id, r.parent_turn] < r.position for r in got if r.parent_turn is not None)
    parent = {(r.conv_id, r.turn): r.parent_turn for r in got}

    def path(c, t):
        return (*path(c, parent[c, t]), t) if parent[c, t] is not None else (t,)

    assert [(r.conv_id, r.turn) for r in order] == sorted(parent, key=lambda k: (k[0], path(*k)))
    assert [r.conv_id for r in order] == sorted(r.conv_id for r in got)


def test_ten_thousand_messages_match_sql(spark, tmp_path):
    messages = talk(5, 200, 50) + [(500, i, "user", f"> m{i - 1}\nm{i}") for i in range(300)] + [(None, 1, None, "> x\ny"), (501, None, "u", "> x"), (502, 0, "u", None)]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    df.repartition(5).write.parquet(f"{tmp_path}/c")
    got = chat.query(spark.read.parquet(f"{tmp_path}/c")).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    cur = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got[0].asDict())
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(cur.fetchall(), key=str)
    assert sum(r.parent_turn is not None for r in got) > 5000 and max(r.depth for r in got) == 299


@pytest.mark.parametrize("most", [200, 2])
def test_rendered_texts_are_the_messages_in_order(spark, most):
    messages = [(1, 0, "user", "a"), (1, 1, "assistant", "> a\nb"), (1, 2, "user", "> b\nc"), (2, 0, None, "d")]
    rows = chat.conversations(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv_id, r.part, r.text, r.n_messages) for r in chat.rendered(rows, most).collect())
    assert "".join(t for c, _, t, _ in got if c == 1) == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n"
    assert [t for c, _, t, _ in got if c == 2] == ["<|unknown|>\nd\n"] and max(n for *_, n in got) <= most


def test_branches_of_a_thread_are_read_one_by_one(spark):
    got = result(
        spark, (1, 0, "u", "one"), (1, 1, "a", "> one\ntwo"), (1, 2, "a", "> one\nthree"), (1, 3, "u", "> two\nfour"), (1, 4, "u", "> three\nfive"),
        (1, 5, "u", "> two\nsix"), (1, 6, "a", "> four\nseven"), (1, 7, "u", "alone"),
    )
    assert [t for _, t in sorted((r.position, t) for (_, t), r in got.items())] == [0, 1, 3, 6, 5, 2, 4, 7]


def test_a_message_with_very_many_answers(spark):
    n = 3000
    got = result(spark, (1, 0, "u", "one"), *[(1, i, "a", f"> one\nanswer {i}") for i in range(1, n)])
    assert [r.position for _, r in sorted(got.items())] == list(range(n)) and {r.depth for r in got.values()} == {0, 1}
