"""Mentions, notifications, comments, notes and what people may do (M1 to M7, M10, M11, M16, M18, ST13 to ST20, A14, J11, J19 to J21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, bounded_writer_text, js_trim
from .ordered import fold_sorted

MENTION = r"@\[\[([0-9a-fA-F-]{36}):([^\[\]]*)\]\]"
# Roles that may edit, and titles of drafts by mode.
EDITORS = ("OWNER", "EDITOR")
TITLES = {"compare_studies": "Study comparison", "methodology_summary": "Methodology summary", "findings_synthesis": "Findings synthesis", "limitations_future_work": "Limitations and future work"}


def mentioned(body: Column) -> Column:
    """M1: people mentioned, each once in order of the first mention."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(MENTION), F.lit(1)))


def segments(body: Column) -> Column:
    """M2: a body as array of (kind, text, person): what stands between mentions, and the mentions by their names."""
    parts = F.regexp_extract_all(body, F.lit(rf"{MENTION}|(?:(?!{MENTION})[\s\S])+"), F.lit(0))
    is_mention = lambda p: p.rlike(f"^{MENTION}$")
    return F.transform(parts, lambda p: F.struct(F.when(is_mention(p), "mention").otherwise("text").alias("kind"), F.when(is_mention(p), F.regexp_extract(p, MENTION, 2)).otherwise(p).alias("text"), F.when(is_mention(p), F.regexp_extract(p, MENTION, 1)).alias("person")))


def active_query(text: Column, cursor: Column) -> Column:
    """M3: struct of start and query of the mention being typed before a cursor; null outside one."""
    before = F.left(text, cursor)
    at = F.length(before) - F.instr(F.reverse(before), "@")
    query = F.substr(before, at + 2, F.length(before))
    lead = F.substr(before, at, F.lit(1))
    good = before.contains("@") & ~((at > 0) & lead.rlike(r"[A-Za-z0-9_\]]")) & ~query.rlike(rf"{WS}|[\[\]]")
    return F.when(good, F.struct(at.cast("int").alias("start"), query.alias("query")))


def insert_mention(text: Column, start: Column, end: Column, person: Column, name: Column) -> Column:
    """M3: the text with a mention in place of what was typed."""
    return F.concat(F.left(text, start), F.concat(F.lit("@[["), person, F.lit(":"), name, F.lit("]] ")), F.substr(text, end + 1, F.length(text)))


def activity_message(kind: Column, actor: Column, target: Column) -> Column:
    """M4: one line of an activity feed."""
    # What the kinds of activity say.
    said = {"paper_linked": "added", "paper_unlinked": "removed", "discussion_opened": "opened a discussion on", "discussion_resolved": "resolved a discussion on", "comment_added": "commented on", "assignment_created": "assigned", "note_edited": "edited a note on"}
    verb = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), kind), F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.concat_ws(" ", F.coalesce(actor, F.lit("Someone")), verb, target)


def may(role: Column, user: Column, author: Column, assignee: Column) -> Column:
    """M5: struct of what a member may do: comment, edit (resolve, assign, write notes), change an assignment's status, and modify a comment."""
    member, no = role.isNotNull(), F.lit(False)
    own = F.coalesce(user == author, no)
    return F.struct(member.alias("comment"), F.coalesce(role.isin(*EDITORS), no).alias("edit"), (member & (own | F.coalesce(user == assignee, no))).alias("update_assignment"), own.alias("modify_comment"))


def format_bytes(n: Column) -> Column:
    """M6: `0 MB`, `512 B`, `1.5 KB`, `12 MB`."""
    power = F.least(F.when(n < 1 << 10, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3), F.lit(3))
    value = n / F.pow(F.lit(1024.0), power)
    unit = F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB"])), power + 1)
    shown = F.when((value >= 10) | (power == 0), F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(n <= 0, "0 MB").otherwise(F.concat_ws(" ", shown, unit))


def initials(name: Column) -> Column:
    """M7: the first letters of the first two words, a question mark without any."""
    words = F.filter(F.split(js_trim(name), f"{WS}+"), lambda w: w != "")
    letter = lambda i: F.upper(F.substring(F.coalesce(F.get(words, F.lit(i)), F.lit("")), 1, 1))
    return F.concat(F.when(F.size(words) == 0, "?").otherwise(letter(0)), letter(1))


def bounded_count(n: Column) -> Column:
    """A whole number from 0 to 2**53 - 1, null else."""
    d = n.try_cast("double")
    return F.when((d >= 0) & (d <= float((1 << 53) - 1)) & (d == F.floor(d)), d.cast("long"))


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, as seconds or as a date; null for neither."""
    text = js_trim(value)
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    left = (date.cast("timestamp").cast("double") - now.cast("timestamp").cast("double")) * 1000
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.round(text.try_cast("double") * 1000)).otherwise(F.when(left.isNotNull(), F.greatest(F.lit(0.0), left))).cast("long")


def label(value: Column, labels: dict[str, str], other: str = "") -> Column:
    """A fixed label, or the value with spaces for underscores."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value)
    return F.coalesce(known, F.lit(other) if other else F.replace(value, F.lit("_"), F.lit(" ")))


def draft_title(frame: DataFrame, mode: str = "mode", focus: str = "focus") -> DataFrame:
    """Frame with title: the fixed one of the mode, or the focus cut to 200 characters in all."""
    prefix = "Literature synthesis: "
    told = frame.withColumn("title", F.concat(F.lit(prefix), bounded_writer_text(F.col(focus), 200 - len(prefix))))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col(mode))
    return told.withColumn("title", F.coalesce(known, F.col("title")))


# --- state from events --------------------------------------------------------------------------------------
def invitations(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """ST13: each invitation's state from events(invitation, ts, action): accepted if that came in time, else expired or pending."""
    a = events.groupBy("invitation").agg(F.min(F.when(F.col("action") == "create", F.col("ts"))).alias("created"), F.min(F.when(F.col("action") == "accept", F.col("ts"))).alias("accepted"))
    ends = F.col("created") + F.expr(f"interval {days} days")
    return a.where("created is not null").select("invitation", F.when((F.col("accepted") >= F.col("created")) & (F.col("accepted") < ends), "accepted").when(now >= ends, "expired").otherwise("pending").alias("state"))


def discussions(events: DataFrame) -> DataFrame:
    """ST14: each discussion's opener, state and last change from events(discussion, seq, actor, action); a change that finds its state already there is none."""
    last = F.max_by("action", F.when(F.col("action").isin("open", "resolve", "reopen"), F.col("seq")))
    w = Window.partitionBy("discussion").orderBy("seq")
    moved = events.where(F.col("action").isin("open", "resolve", "reopen"))
    moved = moved.withColumn("is_open", F.col("action") != "resolve").withColumn("changes", ~F.col("is_open").eqNullSafe(F.lag("is_open").over(w)))
    return moved.groupBy("discussion").agg(F.min_by("actor", "seq").alias("opener"), F.when(last == "resolve", "resolved").otherwise("open").alias("state"), F.count_if("changes").alias("changes"))


def notifications(comments: DataFrame, openers: DataFrame) -> DataFrame:
    """ST15: who learns of comments(comment, discussion, author, body): people mentioned, and the discussion's opener of a reply unless mentioned; never the author.

    openers(discussion, opener). Returns comment, person, kind.
    """
    told = comments.select("comment", "discussion", "author", F.explode(mentioned(F.col("body"))).alias("person")).select("comment", "author", "person", F.lit("mention").alias("kind"))
    replies = comments.join(openers, "discussion").select("comment", "author", F.col("opener").alias("person"), F.lit("reply").alias("kind"))
    replies = replies.join(told.select("comment", "person"), ["comment", "person"], "left_anti").select("comment", "author", "person", "kind")
    return told.unionByName(replies).where("person <> author").select("comment", "person", "kind")


def comments_now(events: DataFrame) -> DataFrame:
    """ST16: comments as they stand from events(comment, seq, actor, action, body): the author's last edit, and no body once deleted."""
    first = events.where("action = 'add'").groupBy("comment").agg(F.min_by(F.struct("actor", "body", "seq"), "seq").alias("a"))
    own = events.where("action in ('edit', 'delete')").join(first, "comment").where((F.col("actor") == F.col("a.actor")) & (F.col("seq") > F.col("a.seq")))
    gone = own.groupBy("comment").agg(F.min(F.when(F.col("action") == "delete", F.col("seq"))).alias("gone"))
    edits = own.join(gone, "comment").where("action = 'edit' and (gone is null or seq < gone)").groupBy("comment").agg(F.max_by("body", "seq").alias("edited"), F.lit(True).alias("is_edited"))
    rows = first.join(gone, "comment", "left").join(edits, "comment", "left")
    return rows.select("comment", F.col("a.actor").alias("author"), F.when(F.col("gone").isNull(), F.coalesce("edited", F.col("a.body"))).alias("body"), F.coalesce("is_edited", F.lit(False)).alias("edited"), F.col("gone").isNotNull().alias("deleted"))


def assignments(events: DataFrame) -> DataFrame:
    """ST17: each assignment's last status from events(assignment, seq, actor, role, assigner, assignee, status) that its parties sent; editors create it."""
    made = events.where(F.col("status") == "open").where(F.col("role").isin(*EDITORS)).groupBy("assignment").agg(F.min_by(F.struct("seq", "assigner", "assignee"), "seq").alias("m"))
    moves = events.join(made, "assignment").where((F.col("seq") >= F.col("m.seq")) & ((F.col("actor") == F.col("m.assigner")) | (F.col("actor") == F.col("m.assignee"))))
    return made.join(moves.groupBy("assignment").agg(F.max_by("status", "seq").alias("status")), "assignment", "left").select("assignment", F.col("m.assignee").alias("assignee"), F.coalesce("status", F.lit("open")).alias("status"))


def notes(edits: DataFrame) -> DataFrame:
    """ST18: edits(note, seq, expected, body) with revision and accepted: an edit counts only if it expects the revision that stands."""

    def start() -> int:
        return 0

    def step(revision: int, row: tuple) -> tuple[int, tuple]:
        accepted = row[2] == revision
        revision += accepted
        return revision, (row[0], row[1], revision, bool(accepted))

    kept = edits.select(F.col("note").cast("long").alias("note"), F.col("seq").cast("long").alias("seq"), F.col("expected").cast("long").alias("expected"))
    return fold_sorted(kept, ["note"], ["seq", "expected"], start, step, "note long, seq long, revision long, accepted boolean")


def read_marks(sent: DataFrame, marks: DataFrame) -> DataFrame:
    """ST19, A14: notifications sent(person, notification, ts) with read: whether the person marked all as read since; unread ones are counted from these."""
    last = marks.groupBy("person").agg(F.max("ts").alias("marked"))
    return sent.join(last, "person", "left").withColumn("read", F.coalesce(F.col("marked") >= F.col("ts"), F.lit(False))).drop("marked")


def derived_activity(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ST20: links that appear or go between two snapshots, as activity."""
    keys = list(keys)
    new = after.select(keys).distinct().join(before, keys, "left_anti").withColumn("kind", F.lit("paper_linked"))
    return new.unionByName(before.select(keys).distinct().join(after, keys, "left_anti").withColumn("kind", F.lit("paper_unlinked")))


def own_roles(projects: DataFrame, members: DataFrame, actor: str) -> DataFrame:
    """The actor's role in each of projects(project_id), as members(project_id, user_id, role) has it, or null; one join for all, and of several rows the highest role."""
    rank = F.when(F.col("role") == "OWNER", 0).when(F.col("role") == "EDITOR", 1).otherwise(2)
    mine = members.where(F.col("user_id") == actor).groupBy("project_id").agg(F.min_by("role", rank).alias("role"))
    return projects.join(mine, "project_id", "left").select("project_id", "role")


def members(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """members(project_id, user_id, role, joined) by name, in order of joining; unknown people keep a fallback name."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("joined", "user_id"))
    named = rows.join(profiles.select("user_id", "name"), "user_id", "left")
    return named.select("project_id", "user_id", "role", F.coalesce(F.nullif(js_trim("name"), F.lit("")), F.lit("Unknown member")).alias("name"), place.alias("place"))
