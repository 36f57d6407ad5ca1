"""Source trees: symbols by language, the reference graph between files, and a digest of the files that matter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import pagerank

#: Names shorter than this are no references.
NAME_LEAST = 3


@dataclass
class Language:
    name: str
    extensions: list[str]
    rules: list[tuple[str, str]]  # kind, pattern whose group ``name`` is the symbol


_ID = r"(?P<name>[A-Za-z_$][\w$]*)"

#: Definitions that each language's lines may hold; the first rule that fits a line names its symbol. Plugins add more.
LANGUAGES = [
    Language("rust", ["rs"], [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_ID}"), ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_ID}"), ("const", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+{_ID}")]),
    Language("python", ["py"], [("class", rf"^\s*class\s+{_ID}"), ("method", rf"^\s+(?:async\s+)?def\s+{_ID}\s*\(\s*(?:self|cls)\b"), ("function", rf"^(?:async\s+)?def\s+{_ID}")]),
    Language("javascript", ["js", "jsx", "mjs", "cjs"], [("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{_ID}"), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_ID}"), ("const", rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}\s*=")]),
    Language("typescript", ["ts", "tsx"], [("interface", rf"^\s*(?:export\s+)?interface\s+{_ID}"), ("type", rf"^\s*(?:export\s+)?type\s+{_ID}\b"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_ID}"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+{_ID}"), ("const", rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}\b")]),
    Language("go", ["go"], [("method", rf"^func\s+\([^)]*\)\s*{_ID}\s*\("), ("function", rf"^func\s+{_ID}\s*[\[(]"), ("struct", rf"^\s*type\s+{_ID}\s+struct\b"), ("interface", rf"^\s*type\s+{_ID}\s+interface\b"), ("type", rf"^\s*type\s+{_ID}\s"), ("const", r"^\s*(?:const|var)\s+(?P<name>[A-Z]\w*)")]),
    Language("java", ["java"], [("interface", rf"^\s*(?:[\w@]+\s+)*interface\s+{_ID}"), ("enum", rf"^\s*(?:[\w@]+\s+)*enum\s+{_ID}"), ("class", rf"^\s*(?:[\w@]+\s+)*(?:class|record)\s+{_ID}"), ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+{_ID}\s*\(")]),
    Language("kotlin", ["kt", "kts"], [("interface", rf"^\s*(?:\w+\s+)*interface\s+{_ID}"), ("class", rf"^\s*(?:\w+\s+)*class\s+{_ID}"), ("object", rf"^\s*(?:companion\s+)?object\s+{_ID}"), ("function", rf"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{_ID}\s*\(")]),
    Language("swift", ["swift"], [("protocol", rf"^\s*(?:\w+\s+)*protocol\s+{_ID}"), ("struct", rf"^\s*(?:\w+\s+)*struct\s+{_ID}"), ("enum", rf"^\s*(?:\w+\s+)*enum\s+{_ID}"), ("class", rf"^\s*(?:\w+\s+)*(?:class|actor)\s+{_ID}"), ("function", rf"^\s*(?:@?\w+\s+)*func\s+{_ID}")]),
    Language("c", ["c", "h", "cc", "cpp", "cxx", "hpp", "hh"], [("struct", rf"^\s*(?:typedef\s+)?struct\s+{_ID}"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_ID}"), ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_ID}"), ("const", rf"^\s*#define\s+{_ID}"), ("function", rf"^(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?:\w+::)*{_ID}\s*\([^;]*$")]),
    Language("ruby", ["rb"], [("module", rf"^\s*module\s+(?:\w+::)*{_ID}"), ("class", rf"^\s*class\s+(?:\w+::)*{_ID}"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")]),
    Language("php", ["php"], [("interface", rf"^\s*interface\s+{_ID}"), ("trait", rf"^\s*trait\s+{_ID}"), ("class", rf"^\s*(?:abstract\s+|final\s+)*class\s+{_ID}"), ("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_ID}")]),
]


def plugins(folder: str) -> list[Language]:
    """Languages from TOML files: name, extensions, and rules of kind and pattern (group ``name`` or the first one)."""
    import tomllib
    from pathlib import Path

    out = []
    for path in sorted(Path(folder).glob("*.toml")):
        d = tomllib.loads(path.read_text())
        out.append(Language(d["name"], [e.lstrip(".") for e in d["extensions"]], [(r["kind"], r["pattern"]) for r in d.get("rules", [])]))
    return out


def symbols(files: DataFrame, languages: list[Language] = LANGUAGES) -> DataFrame:
    """path, line (from 1), kind, name, signature for files (path, content)."""
    by = {e: [(k, re.compile(p)) for k, p in lang.rules] for lang in languages for e in lang.extensions}
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rules = by.get((path or "").rpartition(".")[2].lower(), [])
                for i, line in enumerate((content or "").split("\n") if rules else []):
                    for kind, rx in rules:
                        m = rx.match(line)
                        if m:
                            name = m["name"] if "name" in rx.groupindex else m[1]
                            if name not in ("if", "for", "while", "switch", "return", "else"):
                                rows.append((path, i + 1, kind, name, line.strip()))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "line", "kind", "name", "signature"])

    return files.select("path", "content").mapInArrow(find, "path string, line int, kind string, name string, signature string")


def references(files: DataFrame, defined: DataFrame) -> DataFrame:
    """src, dst: a file that mentions a name and another file that defines it, once."""
    used = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))).alias("name"))
    homes = defined.where(F.length("name") >= NAME_LEAST).select("name", F.col("path").alias("dst")).distinct()
    return used.join(homes, "name").where("src <> dst").select("src", "dst").distinct()


def restart_weights(files: DataFrame, defined: DataFrame, query: str, path_boost: float = 2.0, symbol_boost: float = 1.0, share: float = 0.8) -> DataFrame:
    """node, weight: 80 % on files whose path or symbols hold a query word, 20 % even; all even if none does."""
    words = [w for w in re.findall(r"[a-z0-9_]+", query.lower()) if len(w) >= NAME_LEAST]
    hits = lambda c: sum((F.lower(F.col(c)).contains(w).cast("double") for w in words), F.lit(0.0))
    by_path = files.select("path", (hits("path") * path_boost).alias("w"))
    by_name = defined.select("path", (hits("name") * symbol_boost).alias("w"))
    w = by_path.union(by_name).groupBy("path").agg(F.sum("w").alias("w")).join(files.select("path"), "path")
    sums = w.agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    return w.crossJoin(F.broadcast(sums)).select(F.col("path").alias("node"), F.when(F.col("total") > 0, share * F.col("w") / F.col("total") + (1 - share) / F.col("n")).otherwise(1 / F.col("n")).alias("weight"))


def navigate(files: DataFrame, query: str = "", max_tokens: int = 1500, per_file: int = 20, languages: list[Language] = LANGUAGES) -> DataFrame:
    """rank, path, line, kind, name, signature: the digest of files by personalised PageRank, cut by tokens."""
    defined = symbols(files, languages)
    ranks = pagerank(files.select(F.col("path").alias("node")), references(files, defined), restart_weights(files, defined, query))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    lines = defined.withColumn("nth", nth).where(F.col("nth") <= per_file).join(ranks.withColumnRenamed("node", "path").withColumnRenamed("rank", "score"), "path")
    # A digest is a few thousand tokens: the best lines are few enough to be ordered as one.
    best = lines.withColumn("tokens", T.count_tokens("signature") + 2).orderBy(F.col("score").desc(), "path", "line").limit(max_tokens)
    order = Window.orderBy(F.col("score").desc(), "path", "line")
    return best.withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= max_tokens).select(F.dense_rank().over(Window.orderBy(F.col("score").desc(), "path")).alias("rank"), "path", "line", "kind", "name", "signature")
