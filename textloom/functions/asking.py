"""Expressions over queries and commands: synonyms, several-hop questions, command families, command wrapping."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .rules import ASKING_STOP, FILLERS

# Words that a query word also asks for.
SYNONYMS = {
    "art": ["painting", "drawing", "sculpture", "artwork", "canvas", "creative"],
    "painting": ["art", "artwork", "canvas", "painter"],
    "music": ["song", "concert", "band", "album", "musical", "instrument"],
    "writing": ["book", "novel", "screenplay", "blog", "journal", "author"],
    "book": ["novel", "reading", "author", "literature"],
    "food": ["restaurant", "cooking", "meal", "dish", "cuisine"],
    "restaurant": ["food", "dining", "meal", "pizza", "cuisine"],
    "travel": ["trip", "flight", "vacation", "visit", "destination"],
    "trip": ["travel", "journey", "road", "vacation"],
    "game": ["gaming", "console", "play", "player", "video"],
    "games": ["gaming", "console", "play", "player", "video"],
    "console": ["game", "gaming", "switch", "playstation", "xbox"],
    "code": ["programming", "coding", "software", "developer"],
    "project": ["working", "building", "developing", "app", "tool"],
    "friend": ["colleague", "partner", "buddy", "companion"],
    "colleague": ["friend", "coworker", "teammate", "partner"],
    "family": ["sister", "brother", "mother", "father", "parent"],
    "peace": ["calm", "comfort", "healing", "therapeutic", "relax"],
    "health": ["exercise", "yoga", "running", "wellness", "medical"],
    "exercise": ["run", "running", "yoga", "workout", "marathon"],
    "pet": ["dog", "cat", "puppy", "kitten", "animal"],
    "dog": ["pet", "puppy", "retriever", "breed"],
    "cat": ["pet", "kitten", "feline"],
    "recently": ["lately", "last", "new", "current", "past"],
    "favorite": ["prefer", "favourite", "best", "love", "like"],
    "hobby": ["interest", "passion", "activity", "enjoy"],
}

# Cues of a question that needs several steps.
HOP_MARKERS = ["compare", "comparison", "difference between", "differences between", "versus", " vs ", " vs. ", "both ", "either ", "neither ", "after ", "before ", "while ", "during ", "then ", "previously", "earlier", "and then", "as well as"]

# Families of commands, the first that fits.
FAMILIES = [
    ("git", r"^\s*git(\s|$)"),
    ("test_runner", r"^\s*(cargo\s+test|pytest|python\s+-m\s+pytest|vitest|jest|go\s+test|npm\s+test|pnpm\s+test)"),
    ("build", r"^\s*(cargo\s+(build|clippy|check)|tsc|eslint|biome|make\b|ninja|bazel)"),
    ("search", r"^\s*(grep|rg|ripgrep|ag|ack)\b"),
    ("filesystem", r"^\s*(ls|tree|find|du|df|stat)\b"),
    ("docker", r"^\s*(docker|podman|kubectl|helm)\b"),
    ("cloud", r"^\s*(aws|gcloud|az)\b"),
]

# Commands whose output is worth shrinking, by rule name.
WRAPPED = [
    ("git_status", r"^\s*git\s+status\b"), ("git_diff", r"^\s*git\s+diff\b"), ("git_log", r"^\s*git\s+log\b"), ("git_show", r"^\s*git\s+show\b"),
    ("git_stash_list", r"^\s*git\s+stash\s+list\b"), ("git_branch", r"^\s*git\s+branch\b"), ("git_push", r"^\s*git\s+push\b"), ("git_pull", r"^\s*git\s+pull\b"),
    ("git_fetch", r"^\s*git\s+fetch\b"), ("cargo_test", r"^\s*cargo\s+test\b"), ("pytest", r"^\s*(pytest|python\s+-m\s+pytest)\b"), ("vitest_jest", r"^\s*(vitest|jest|(npm|pnpm|yarn)\s+test)\b"),
    ("go_test", r"^\s*go\s+test\b"), ("cargo_build", r"^\s*cargo\s+(build|clippy|check)\b"), ("ls", r"^\s*ls(\s|$)"), ("tree", r"^\s*tree(\s|$)"),
    ("find", r"^\s*find\s"), ("grep", r"^\s*(grep|rg|ripgrep|ag|ack)\b"), ("docker_ps", r"^\s*(docker|podman)\s+(ps|container\s+ls)\b"), ("docker_logs", r"^\s*(docker|podman|kubectl)\s+logs\b"),
]


def expand(query: Column | str) -> Column:
    """The query with the synonyms of its words that it lacks, once each."""
    q = T.col(query)
    words = F.array_distinct(F.filter(F.split(F.lower(q), r"(?U)\s+"), lambda w: w != ""))
    added = F.concat(*(F.when(F.array_contains(words, k), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")) for k, more in SYNONYMS.items()))
    return F.concat_ws(" ", q, F.nullif(F.array_join(F.array_except(F.array_distinct(added), words), " "), F.lit("")))


def several_hops(query: Column | str) -> Column:
    """Whether a question seems to need several steps: cues, two names, content words joined by and, or its length."""
    q = F.trim(T.col(query))
    words = F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")
    names = F.size(T.spaced_entities(q, ASKING_STOP, None))
    low = F.transform(words, F.lower)
    places = F.when(F.size(words) >= 6, F.sequence(F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    joined = F.exists(places, lambda i: (F.get(low, i) == "and") & ~F.get(low, i - 1).isin(FILLERS) & ~F.get(low, i + 1).isin(FILLERS))
    return F.when(q == "", False).otherwise(T.contains_any(F.lower(q), HOP_MARKERS) | (names >= 2) | joined | (F.size(words) > 14))


def command_family(command: Column | str) -> Column:
    out = F.lit("generic")
    for name, p in reversed(FAMILIES):
        out = F.when(T.col(command).rlike(p), name).otherwise(out)
    return out


def wrap(command: Column | str, wrapper: str = "textloom exec -- ") -> Column:
    """rule and command: commands of the table get the wrapper; pipes, chains, here-documents and wrapped ones stay."""
    c = F.trim(T.col(command))
    rule = F.lit(None).cast("string")
    for name, p in reversed(WRAPPED):
        rule = F.when(c.rlike(p), name).otherwise(rule)
    rule = F.when(c.startswith(wrapper.split()[0]) | c.contains("<<") | c.contains("|") | c.contains("&&"), F.lit(None)).otherwise(rule)
    return F.struct(rule.alias("rule"), F.when(rule.isNotNull(), F.concat(F.lit(wrapper), c)).otherwise(T.col(command)).alias("command"))


def register(spark: SparkSession) -> list[str]:
    """Makes text functions callable from SQL as temporary functions; returns their names."""
    made = {
        "tl_tokens": (f"regexp_count(t, r'{T.TOKEN}')", "INT"),
        "tl_short_hash": ("substring(sha2(t, 256), 1, 16)", "STRING"),
        "tl_words": (f"regexp_extract_all(lower(t), r'{T.WORD}', 0)", "ARRAY<STRING>"),
        "tl_normal_line": (rf"trim(regexp_replace(regexp_replace(t, r'{T.TIMESTAMP}', '<TS>'), r'\d+', '<N>'))", "STRING"),
    }
    for name, (body, kind) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return sorted(made)
