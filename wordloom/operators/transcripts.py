"""Digests of session transcripts: prompts, commands, tools, artifacts, skills and the corrections that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import SPACE, is_correction, is_documentation_path, strip_space
from wordloom.session import cut

#: How many of each kind a digest keeps, and how many characters of each.
MOST = {"prompts": 200, "commands": 200, "artifacts": 100, "tool_sequence": 2000, "skills": 50, "corrections": 10}
LENGTH = {"prompt": 1000, "command": 200, "path": 200, "correction": 300, "program": 40}
#: Prompts after a skill that may correct it.
CORRECTION_WINDOW = 6
#: Tools that write files, and slash commands that are no skills.
ARTIFACT_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
BUILTIN_COMMANDS = (
    "clear", "compact", "config", "cost", "exit", "help", "init", "login", "logout", "mcp", "memory", "model",
    "permissions", "plugin", "resume", "status",
)

_BLOCKS = (
    "array<struct<type string, text string, name string, input struct<skill string, name string, command string, "
    "file_path string, notebook_path string, path string>>>"
)


def skill_name(raw: Column) -> Column:
    """The skill that ``plugin:skill`` or ``/skill`` names."""
    return strip_space(F.element_at(F.split(F.regexp_replace(strip_space(raw), "^/+", ""), ":"), -1))


def _json(line: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(line, p, "string") for p in paths])


def _decoded(lines: DataFrame) -> DataFrame:
    """``session_id, line_no, role, text, blocks`` of each line that is JSON and not meta."""
    v = lines.select("session_id", "line_no", F.try_parse_json("raw").alias("v")).where("v is not null")
    v = v.where(~F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False)))
    content = F.coalesce(F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$.content", "variant"))
    v = v.select("session_id", "line_no", "v", content.alias("content"))
    is_list = F.schema_of_variant("content").startswith("ARRAY")
    return v.select(
        "session_id", "line_no", _json(F.col("v"), "$.message.role", "$.role", "$.type").alias("role"),
        F.when(F.schema_of_variant("content") == "STRING", F.col("content").cast("string")).alias("text"),
        F.when(is_list, F.from_json(F.to_json("content"), _BLOCKS)).alias("blocks"),
    )


#: For ``most`` and ``length``: nothing is cut.
ALL = dict.fromkeys([*MOST, *LENGTH], 1 << 30)


def items(lines: DataFrame, length: dict[str, int] = LENGTH) -> DataFrame:
    """``session_id, line_no, pos, kind, value, tool``: what a transcript's lines hold, in order.

    ``lines(session_id, line_no, raw)`` are JSON lines; torn ones and meta messages are skipped. Kinds are prompt, skill,
    command, artifact and tool; one block may give several. Messages made only of tool results and harness tags are none.
    """
    d = _decoded(lines)
    typed = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    said = strip_space(F.coalesce("text", typed))
    users = d.where("role = 'user'").select("session_id", "line_no", said.alias("said")).where("said <> ''")
    slash = skill_name(F.regexp_extract("said", r"(?s)<command-name>(.*?)(?:</command-name>|$)", 1))
    users = users.select("session_id", "line_no", "said", slash.alias("slash"))
    prompts = users.select(
        "session_id", "line_no", F.lit(0).alias("pos"),
        F.when(F.col("slash") != "", F.when(~F.col("slash").isin(*BUILTIN_COMMANDS), F.lit("skill")))
        .when(~F.col("said").startswith("<"), "prompt").alias("kind"),
        F.when(F.col("slash") != "", F.col("slash")).otherwise(F.col("said")).alias("value"),
    ).where("kind is not null")
    uses = d.where("role = 'assistant'").select("session_id", "line_no", F.posexplode("blocks").alias("pos", "b"))
    uses = uses.where((F.col("b.type") == "tool_use") & F.col("b.name").isNotNull())
    skill = skill_name(F.coalesce("b.input.skill", "b.input.name", F.lit("")))
    command = strip_space(F.coalesce("b.input.command", F.lit("")))
    name, program = F.col("b.name"), F.substring(F.element_at(F.split(command, SPACE), 1), 1, length["program"])
    token = (
        F.when(name == "Skill", F.when(skill != "", F.concat(F.lit("Skill:"), skill)).otherwise(name))
        .when(name == "Bash", F.when(command != "", F.concat(F.lit("Bash:"), program)).otherwise(name)).otherwise(name)
    )
    path = F.substring(strip_space(F.coalesce("b.input.file_path", "b.input.notebook_path", "b.input.path")), 1, length["path"])
    found = F.array_compact(
        F.array(
            F.when((name == "Skill") & (skill != ""), F.struct(F.lit("skill").alias("kind"), skill.alias("value"))),
            F.when((name == "Bash") & (command != ""), F.struct(F.lit("command").alias("kind"), F.substring(command, 1, length["command"]).alias("value"))),
            F.when(name.isin(*ARTIFACT_TOOLS) & is_documentation_path(path), F.struct(F.lit("artifact").alias("kind"), path.alias("value"))),
            F.struct(F.lit("tool").alias("kind"), token.alias("value")),
        )
    )
    tools = uses.select("session_id", "line_no", (F.col("pos") + 1).alias("pos"), F.explode(found).alias("f")).select("session_id", "line_no", "pos", "f.kind", "f.value")
    return prompts.union(tools)


def digests(lines: DataFrame, most: dict[str, int] = MOST, length: dict[str, int] = LENGTH) -> DataFrame:
    """A row per session: ``prompts, commands, artifacts, tool_sequence, skill_uses``, each in order and up to ``most``; ALL keeps all.

    A skill is followed by a window of CORRECTION_WINDOW prompts, closed by the next skill; those that redirect the
    agent are its corrections. Every list is cut before it is gathered. Sessions without any item have no row.
    """
    every = cut(items(lines, length))  # each part reads its kind of it
    order = ["line_no", "pos"]

    def gathered(kind: str, name: str, limit: int, value: Column) -> DataFrame:
        rows = every.where(F.col("kind") == kind).select("session_id", *order, value.alias("value"))
        if kind == "artifact":
            rows = rows.groupBy("session_id", "value").agg(F.min(F.struct(*order)).alias("o")).select("session_id", "o.*", "value")
        place = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
        kept = rows.withColumn("n", place).where(F.col("n") <= limit)
        listed = F.sort_array(F.collect_list(F.struct("n", "value")))
        return kept.groupBy("session_id").agg(F.transform(listed, lambda x: x["value"]).alias(name))

    parts = [
        gathered("prompt", "prompts", most["prompts"], F.substring("value", 1, length["prompt"])),
        gathered("command", "commands", most["commands"], F.col("value")),
        gathered("artifact", "artifacts", most["artifacts"], F.col("value")),
        gathered("tool", "tool_sequence", most["tool_sequence"], F.col("value")),
        _skill_uses(every, most, length),
    ]
    ids = every.select("session_id").distinct()
    for part in parts:
        ids = ids.join(part, "session_id", "left")
    empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in ids.dtypes[1:]]
    return ids.select("session_id", *empty)


def _skill_uses(every: DataFrame, most: dict[str, int], length: dict[str, int]) -> DataFrame:
    talk = every.where("kind in ('skill', 'prompt')")
    # a session is one transcript, which its reader keeps to a few megabytes
    session = Window.partitionBy("session_id").orderBy("line_no", "pos")
    use = F.sum((F.col("kind") == "skill").cast("int")).over(session.rowsBetween(Window.unboundedPreceding, 0))
    opened = talk.withColumn("use", use).where((F.col("use") > 0) & (F.col("use") <= most["skills"]))
    nth = F.row_number().over(Window.partitionBy("session_id", "use").orderBy("line_no", "pos"))
    near = opened.withColumn("n", nth).where(F.col("n") <= CORRECTION_WINDOW + 1)
    fixes = F.when((F.col("kind") == "prompt") & is_correction("value"), F.struct("n", F.substring("value", 1, length["correction"]).alias("v")))
    per = near.groupBy("session_id", "use").agg(
        F.max(F.when(F.col("kind") == "skill", F.col("value"))).alias("skill"), F.sort_array(F.collect_list(fixes)).alias("c")
    )
    corrections = F.slice(F.transform("c", lambda x: x["v"]), 1, most["corrections"])
    one = per.select("session_id", F.struct("use", "skill", corrections.alias("corrections")).alias("u"))
    uses = F.transform(F.sort_array(F.collect_list("u")), lambda u: F.struct(u["skill"].alias("skill"), u["corrections"].alias("corrections")))
    return one.groupBy("session_id").agg(uses.alias("skill_uses"))


def final_messages(lines: DataFrame) -> DataFrame:
    """``session_id, message``: the text of the last assistant line that has one."""
    d = lines.select("session_id", "line_no", F.try_parse_json("raw").alias("v")).where("v is not null")
    role = F.coalesce(_json(F.col("v"), "$.message.role", "$.role"), F.lit(""))
    spoken = d.where((role == "assistant") | (F.coalesce(_json(F.col("v"), "$.type"), F.lit("")) == "assistant"))

    def text(path: str) -> Column:
        value = F.try_variant_get("v", path, "variant")
        listed = F.from_json(F.when(F.schema_of_variant(value).startswith("ARRAY"), F.to_json(value)), "array<struct<text string>>")
        joined = F.array_join(F.filter(F.transform(listed, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(F.when(joined != "", joined))

    said = F.coalesce(*[text(p) for p in ("$.message.content", "$.content", "$.message.text", "$.text")])
    return spoken.select("session_id", "line_no", said.alias("m")).where("m is not null").groupBy("session_id").agg(F.max_by("m", "line_no").alias("message"))
