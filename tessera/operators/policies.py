"""Who may read which rows: the catalogue of select policies, and reads that pass through it.

A policy says of a column what its values must be for an actor: the actor, a project they belong to or
own, a paper that is theirs or linked to such a project, somebody who shares a project with them. A table
may have several; a row is read if any of them holds. Tables without a policy are not read at all.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Rows whose column holds what the actor may see, and for which the condition, if any, holds too."""

    column: str
    seen: str
    condition: str | None = None


_PROJECT, _PAPER = (Policy("project_id", "project"),), (Policy("paper_id", "paper"),)
# The policies of each table.
POLICIES: dict[str, tuple[Policy, ...]] = {
    "profiles": (Policy("id", "actor"), Policy("id", "person")), "research_projects": (Policy("user_id", "actor"), Policy("id", "project")), "papers": (Policy("user_id", "actor"), Policy("id", "paper")),
    "paper_project_links": _PROJECT, "project_members": _PROJECT, "project_activity": _PROJECT, "discussions": _PROJECT, "comments": _PROJECT, "mentions": _PROJECT, "assignments": _PROJECT, "notes": _PROJECT,
    "paper_sections": _PAPER, "paper_chunks": _PAPER, "paper_pages": _PAPER, "paper_tables": _PAPER, "paper_facts": _PAPER, "paper_extractions": _PAPER, "paper_extraction_fields": _PAPER, "paper_extraction_sources": _PAPER,
    "paper_embedding_jobs": (Policy("user_id", "actor"),), "usage_events": (Policy("actor_user_id", "actor"),), "notifications": (Policy("recipient_id", "actor"),), "embedding_models": (Policy("", "everyone"),),
    "project_invitations": (Policy("project_id", "owned_project"), Policy("recipient_email", "email", "status = 'pending'")),
    "objects": (Policy("folder", "actor", "bucket_id = 'papers'"), Policy("name", "file", "bucket_id = 'papers'")),
}


class Reader:
    """Reads of one actor over tables by name; papers, paper_project_links and project_members decide what else is seen.

    papers(id, user_id, storage_path, ...), paper_project_links(project_id, paper_id), project_members(project_id, user_id, role); an
    object's folder is the first part of its name. A null is never a member, an owner or a recipient; the actor is one value, and their
    e-mail address is compared in lower case.
    """

    def __init__(self, tables: Mapping[str, DataFrame], actor: object, email: str = ""):
        self.tables, self.actor, self.email = tables, actor, email.lower()

    def seen(self, what: str) -> DataFrame:
        """The values of one kind that the actor may see, as (value), each once."""
        members, me = self.tables["project_members"], F.col("user_id") == F.lit(self.actor)
        mine = members.where(me)
        if what == "project":
            found = mine.select(F.col("project_id").alias("value"))
        elif what == "owned_project":
            found = mine.where("role = 'OWNER'").select(F.col("project_id").alias("value"))
        elif what == "person":
            found = members.join(mine.select("project_id"), "project_id", "left_semi").select(F.col("user_id").alias("value"))
        else:
            linked = self.tables["paper_project_links"].join(mine.select("project_id"), "project_id", "left_semi").select(F.col("paper_id").alias("id"))
            papers = self.tables["papers"]
            if what == "paper":
                found = linked.union(papers.where(me).select("id")).select(F.col("id").alias("value"))
            elif what == "file":
                found = papers.join(linked, "id", "left_semi").select(F.col("storage_path").alias("value"))
            else:
                raise ValueError(f"no policy sees {what}")
        return found.where("value is not null").distinct()

    def read(self, name: str) -> DataFrame:
        """The rows of a table that the actor may read; what is compared with other tables goes through semi-joins, so no row comes twice."""
        rows = self.tables[name]
        columns = rows.columns
        if name == "objects":
            rows = rows.withColumn("folder", F.substring_index("name", "/", 1))
        holds = F.lit(False)
        for k, policy in enumerate(POLICIES[name]):
            extra = F.expr(policy.condition) if policy.condition else F.lit(True)
            if policy.seen == "everyone":
                one = F.lit(True)
            elif policy.seen in ("actor", "email"):
                one = F.col(policy.column) == F.lit(self.actor if policy.seen == "actor" else self.email)
            else:
                flag = f"seen_{k}"
                found = self.seen(policy.seen).withColumnRenamed("value", f"value_{k}").withColumn(flag, F.lit(True))
                rows = rows.join(found, rows[policy.column] == found[f"value_{k}"], "left")
                one = F.col(flag)
            holds = holds | F.coalesce(one & extra, F.lit(False))
        return rows.where(holds).select(columns)
