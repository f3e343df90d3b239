"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

`damage` breaks stored conversations in a repeatable way, `repair` mends any rows of (conv_id, turn, role, text).

Rows of a conversation stand in the order of turn (nulls first), then role, then text, both by bytes. A row's first fault
counts: blank (no character but white space), duplicate (its role and text were seen earlier), truncated (its last
character that isn't white space is none of `.!?`). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (blank and
duplicate rows must go), Insert a user or assistant row without text 3; a truncated row that stays adds 3. The roles'
initials must read `(s?(ua)+)?` afterwards; of equally cheap edits those whose initials come first by ASCII are taken.

Four states are enough: nothing yet, system last, user last, assistant last. Rows are sorted over all partitions, so that
a conversation of any length is cut into segments of SEGMENT rows at most. `aggregate()` folds a segment from each of the
four states, each step a few `least` over structs of (cost, audit); a second fold composes a conversation's segments.
Equal costs never meet where one audit begins with the other (the longer has more paid insertions), so that the lesser
audit of a prefix stays the lesser one.

A null role or text is one space; a null conv_id is a conversation of its own and a null turn counts in no gap. Equal rows
are repeats: all but the first are duplicates. Very long texts are hashed as a stream, row by row; SHA-256 can't be
divided, so that the text of one conversation passes through one task, in bounded memory, and its audit is one string.
An empty table gives no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, kept

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a segment are those whose place within a sorted partition agrees but for so many bits.
SEGMENT_BITS = 9
#: Cost of a state that can't be reached.
FAR = 1 << 40
STATES = ("e", "s", "u", "a")
#: Inside, an insertion is I (user) or J (assistant), a new role R (user) or S (assistant); the target follows from the
#: edits before, so that the order of two audits is the same as with I and R alone.
OUTSIDE = ("JS", "IR")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged rows, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text,
    2 removes its `.!?`, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), mark.alias("mark")).where("mark > 0")
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")


def _more(state: Column, letter, cost) -> Column:
    letter, cost = (x if isinstance(x, Column) else F.lit(x) for x in (letter, cost))
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _all(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _start(state: str) -> Column:
    """Only `state` can be reached, at no cost."""
    return _all(*(F.struct(F.lit(0 if x == state else FAR).cast("long").alias("cost"), F.lit("").alias("audit")) for x in STATES))


def _step(acc: Column, row: Column) -> Column:
    """The four states after a row. Insertions stand right before the row that needs them (before a deletion they would
    come later by ASCII)."""
    e, s, u, a = (acc[x] for x in STATES)
    role, extra = row["initial"], F.when(row["fault"] == "truncated", 3).otherwise(0)
    is_, go = (lambda x: role == x), (lambda x: _more(x, "D", 4))
    user = _more(F.least(e, s, a, _more(u, "J", 3)), F.when(is_("u"), "K").otherwise("R"), F.when(is_("u"), 0).otherwise(3) + extra)
    assistant = _more(F.least(u, _more(F.least(e, s, a), "I", 3)), F.when(is_("a"), "K").otherwise("S"), F.when(is_("a"), 0).otherwise(3) + extra)
    stays = _all(go(e), F.when(is_("s"), F.least(go(s), _more(e, "K", extra))).otherwise(go(s)), F.least(go(u), user), F.least(go(a), assistant))
    return F.when(row["fault"].isin("blank", "duplicate"), _all(*map(go, (e, s, u, a)))).otherwise(stays)


def _compose(acc: Column, segment: Column) -> Column:
    """The four states after a segment, whose `ways` are those from each state."""

    def to(end: str) -> Column:
        way = lambda k, x: segment["ways"][k][end]
        return F.least(*(F.struct(F.least(acc[x]["cost"] + way(k, x)["cost"], F.lit(FAR).cast("long")).alias("cost"), F.concat(acc[x]["audit"], way(k, x)["audit"]).alias("audit")) for k, x in enumerate(STATES)))

    return _all(*map(to, STATES))


def _illegal(before: Column, after: Column) -> Column:
    return ~F.concat(before, after).isin("su", "ua", "au")


def ordered(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """`rows` as a written table with their place `at` in the order of all conversations, and the segment it falls in."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows are many partitions' where they are many
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return kept(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("at", segment_bits)), "turns")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, at, segment, initial, fault and the initial before it within the segment, without texts."""
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    light = rows.select("conv_id", "turn", "at", "segment", "role", F.substring("role", 1, 1).alias("initial"), F.sha2("text", 256).alias("digest"), last.alias("last"))
    # the first of each segment, and of these the first: a text that one conversation repeats is a row a segment here
    firsts = light.where("last <> ''").groupBy("conv_id", "role", "digest", "segment").agg(F.min("at").alias("at"))
    firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("at"))).where("nth = 1").select("at", F.lit(True).alias("fresh"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("fresh").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    before = F.lag("initial").over(Window.partitionBy("conv_id", "segment").orderBy("at"))
    light = light.drop("role", "digest").join(firsts, "at", "left").select("conv_id", "turn", "at", "segment", "initial", fault.alias("fault"))
    return light.withColumn("before", before)


def folded(flags: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and the inner audit of each conversation that has rows."""
    has = lambda f: F.count_if(F.col("fault") == f).alias(f)
    segments = flags.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn", "initial", "fault"))).alias("turns"),
        has("blank"), has("duplicate"), has("truncated"), F.count_if(F.col("before").isNotNull() & _illegal(F.col("before"), F.col("initial"))).alias("illegal"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    ways = F.transform(F.array(*map(_start, STATES)), lambda start: F.aggregate("turns", start, _step))
    kinds = F.size(F.array_distinct(F.filter(F.col("turns")["turn"], lambda x: x.isNotNull())))
    segments = segments.select("conv_id", F.struct("segment", ways.alias("ways"), F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last"), "low", "high", kinds.alias("kinds"), "blank", "duplicate", "truncated", "illegal").alias("s"))
    total = lambda f: F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + s[f])
    pairs = F.arrays_zip(F.slice("all", 1, F.size("all") - 1).alias("x"), F.slice("all", 2, F.size("all") - 1).alias("y"))
    meet = lambda f: F.size(F.filter(pairs, lambda p: f(p["x"], p["y"]))).cast("long")
    # sorted by segment: structs compare by their first field, which no two share
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("s"), lambda x, y: F.when(x["segment"] < y["segment"], -1).otherwise(1)).alias("all"))
    turns = total("kinds") - meet(lambda x, y: x["high"] == y["low"])
    high, low = F.array_max(F.col("all")["high"]), F.array_min(F.col("all")["low"])
    whole = whole.select("conv_id", F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long").alias("gaps"), *(total(f).alias(f) for f in ("blank", "duplicate", "truncated")), (total("illegal") + meet(lambda x, y: _illegal(x["last"], y["first"]))).alias("illegal"), F.aggregate("all", _start("e"), _compose).alias("end"))
    end = F.col("end")
    best = F.least(end["e"], end["a"], _more(F.least(end["u"], _more(end["s"], "I", 3)), "J", 3))
    return whole.withColumn("best", best).select("*", "best.cost", "best.audit").drop("end", "best")


def edited(audit: str, rows):
    """The lines of a repaired conversation, of its rows (role, text) in order and its inner audit."""
    at = 0
    for (role, text), edit in zip(rows, re.finditer("([IJ]*)([DKRS])", audit)):
        at = edit.end()
        yield from ("user:" if x == "I" else "assistant:" for x in edit[1])
        if edit[2] != "D":
            yield {"K": role, "R": "user", "S": "assistant"}[edit[2]] + ":" + text
    yield from ("user:" if x == "I" else "assistant:" for x in audit[at:])


def repair(rows: DataFrame, of: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row for each conv_id of `of` (default: of `rows`): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256 (of the repaired `role:text` lines). A conversation without rows: zeros, an empty audit and the
    hash of the empty text."""
    import pyarrow as pa

    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    ids = (rows if of is None else of).select("conv_id").distinct()
    turns = ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced), segment_bits)
    found = folded(flagged(turns))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = ids.join(found, ids.conv_id.eqNullSafe(found.conv_id), "left").select(ids.conv_id, *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
    both = heads.withColumn("at", F.lit(-1).cast("long")).unionByName(turns.select("conv_id", "at", "role", "text"), allowMissingColumns=True)
    both = both.select("conv_id", "at", "role", "text", *numbers, "audit").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    outside = str.maketrans(*OUTSIDE)

    def hashed(batches):
        """A head, then its rows; a conversation may go over several batches."""
        head, done, digest, first, rest = None, [], None, True, iter(())

        def lines(role, text):
            edit = next(rest)
            head["to"] = edit.end()
            yield from edited(edit[0], [(role, text)])

        def add(some):
            nonlocal first
            for line in some:
                digest.update(line.encode() if first else b"\n" + line.encode())
                first = False

        def close():
            if head:
                add(edited(head["audit"][head["to"] :], ()))
                done.append((*head["out"], head["audit"].translate(outside), digest.hexdigest()))

        def out():
            columns = list(zip(*done)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("conv_id"), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, at, role, text, *more in zip(*(c.to_pylist() for c in b.columns)):
                if at < 0:
                    close()
                    head = {"out": (conv, *more[:-1]), "audit": more[-1], "to": 0}
                    digest, first, rest = hashlib.sha256(), True, re.finditer("[IJ]*[DKRS]", more[-1])
                else:
                    add(lines(role, text))
            if len(done) >= 1000:
                yield out()
                done = []
        close()
        if done:
            yield out()

    batch_rows(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.mapInArrow(hashed, ", ".join([f"conv_id {kind}", *(f"{n} long" for n in numbers), "audit string", "repaired_sha256 string"]))


#: The same of table `conversations` in DuckDB's dialect: a recursive walk over each conversation's rows with the four
#: states as (cost, audit, lines); the letters of targets are left out, the lines follow from the audit.
SQL = r"""
with recursive
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
marked as (select *, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)) % 20 as mark from keyed),
damaged as (select conv_id, turn, case when mark = 4 then 'user' else role end as role, case mark when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when mark = 3 then [0, 1] else [0] end) as again from marked where mark > 0),
numbered as (select conv_id, turn, role, text, left(role, 1) as i, rtrim(text, E'\x20\x09\x0a\x0b\x0c\x0d') as body,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged),
faulty as (select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault, lag(i) over (partition by conv_id order by n) as before from numbered),
ids as (select row_number() over () as c, conv_id from (select distinct conv_id from conversations)),
turns as (select c, n, i, role, text, fault in ('b', 'd') as gone, case when fault = 't' then 3 else 0 end as x from faulty join ids on faulty.conv_id is not distinct from ids.conv_id),
walk as (
    select c, 0::bigint as n, {'c': 0, 'a': '', 'r': []::varchar[]} as e, {'c': 1000000000, 'a': '', 'r': []::varchar[]} as s, {'c': 1000000000, 'a': '', 'r': []::varchar[]} as u, {'c': 1000000000, 'a': '', 'r': []::varchar[]} as a from ids
    union all
    select c, n, {'c': e.c + 4, 'a': e.a || 'D', 'r': e.r},
        case when gone or i <> 's' then {'c': s.c + 4, 'a': s.a || 'D', 'r': s.r} else least({'c': s.c + 4, 'a': s.a || 'D', 'r': s.r}, {'c': e.c + x, 'a': e.a || 'K', 'r': list_append(e.r, line)}) end,
        case when gone then {'c': u.c + 4, 'a': u.a || 'D', 'r': u.r} else least({'c': u.c + 4, 'a': u.a || 'D', 'r': u.r}, {'c': pu.c + x + case when i = 'u' then 0 else 3 end, 'a': pu.a || case when i = 'u' then 'K' else 'R' end, 'r': list_append(pu.r, case when i = 'u' then line else 'user:' || text end)}) end,
        case when gone then {'c': a.c + 4, 'a': a.a || 'D', 'r': a.r} else least({'c': a.c + 4, 'a': a.a || 'D', 'r': a.r}, {'c': pa.c + x + case when i = 'a' then 0 else 3 end, 'a': pa.a || case when i = 'a' then 'K' else 'R' end, 'r': list_append(pa.r, case when i = 'a' then line else 'assistant:' || text end)}) end
    from (select w.c, t.n, w.e, w.s, w.u, w.a, t.i, t.gone, t.x, t.text, t.role || ':' || t.text as line,
            least(w.e, w.s, w.a, {'c': w.u.c + 3, 'a': w.u.a || 'I', 'r': list_append(w.u.r, 'assistant:')}) as pu,
            least(w.u, {'c': least(w.e, w.s, w.a).c + 3, 'a': least(w.e, w.s, w.a).a || 'I', 'r': list_append(least(w.e, w.s, w.a).r, 'user:')}) as pa
        from walk w join turns t on w.c = t.c and t.n = w.n + 1) step
),
ends as (select c, least(e, a, {'c': u.c + 3, 'a': u.a || 'I', 'r': list_append(u.r, 'assistant:')}, {'c': s.c + 6, 'a': s.a || 'II', 'r': list_concat(s.r, ['user:', 'assistant:'])}) as best
    from walk where (c, n) in (select c, max(n) from walk group by c)),
counted as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where before is not null and before || i not in ('su', 'ua', 'au')) as illegal from faulty join ids on faulty.conv_id is not distinct from ids.conv_id group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    best.c::bigint as cost, best.a as audit, sha256(array_to_string(best.r, chr(10))) as repaired_sha256
from ids join ends using (c) left join counted using (c)
"""
