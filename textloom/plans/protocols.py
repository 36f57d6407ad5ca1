"""Queries over commands, fields of texts, dates, the delta protocol, and graphs of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import asking
from ..functions import text as T
from ..functions.rules import ASKING_STOP, FILTERS, HIT_STOP, SECTION_TOPICS
from ..operators import code, deltas, graph, memory, outputs, prompts, retrieval

#: Commands that parts stand for, in turn.
COMMANDS = ["git status", "git push origin", "git log -n 5", "git diff HEAD", "cargo test", "pytest -q", "python -m pytest", "npm test", "go test ./...", "ls -la", "tree src", "grep -rn x", "find . -name", "docker ps", "docker logs web", "npm install", "pip install", "terraform plan", "kubectl get pods", "kubectl describe pod", "curl -v http://a", "curl http://a", "make all", "git status | head", "cat <<EOF", "textloom exec -- ls", " rg foo", "aws s3 ls"]

#: Phrases that events stand for, in turn.
PHRASES = ["yesterday", "Last Week", "last month", "last year", "this week", "THIS MONTH", "today", "tomorrow", "last friday", "recently"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _in_turn(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def command_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which filter, family and wrapping rule each command gets."""
    c = F.concat(_in_turn(COMMANDS, "p_partkey"), F.lit(" "), F.col("p_partkey").cast("string"))
    x = _t(spark, sf, "part").select("p_partkey", c.alias("command"))
    return x.select("p_partkey", outputs.filter_name("command").alias("filter"), asking.command_family("command").alias("family"), asking.wrap("command")["rule"].alias("rule"), asking.wrap("command")["command"].alias("wrapped"))


def dated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Relative dates of messages, seen from their time."""
    said = F.concat(F.lit("we met "), _in_turn(PHRASES, "event_id"), F.lit(", not yesterdays"))
    return _t(spark, sf, "events").select("event_id", T.relative_dates(said, "ts").alias("said"))


def text_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Names, ids, complexity and bounds that single texts give."""
    head = F.substring("text", 1, 60)
    return _t(spark, sf, "documents").select(
        "doc_id",
        T.section_name(head).alias("section"),
        T.complexity("text").alias("complexity"),
        T.bounded("text", 50).alias("bounded"),
        T.entity_id(head).alias("entity_id"),
        T.predicate(head).alias("predicate"),
        T.fact_id(T.entity_id(head), F.lit("is"), F.lit("literal"), head).alias("fact_id"),
        F.round(T.parsed_score("text"), 6).alias("score"),
        F.round(T.ratio(T.count_tokens(head), T.count_tokens("text")), 6).alias("ratio"),
    )


def asked_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names in messages: those a query is widened with, and how many a question is taken to have."""
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.spaced_entities("text", HIT_STOP), ",").alias("widened"), F.size(T.spaced_entities("text", ASKING_STOP, None)).cast("long").alias("names"), asking.several_hops("text").alias("several"))


def delta_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for the newest version of a source, from those who know the versions whose doc_id divides by 50."""
    d = _t(spark, sf, "documents")
    snapshots = d.select(F.col("source").alias("path"), F.col("doc_id").alias("version"), F.col("text").alias("content"))
    known = d.where("doc_id % 50 = 0").select(F.col("source").alias("path"), F.col("doc_id").alias("known_version"), T.content_hash("text").alias("known_hash"))
    got = deltas.read_delta(known, snapshots)
    parts = {"prefix": F.col("change.prefix"), "removed": F.col("change.removed"), "inserted": F.size("change.inserted"), "suffix": F.col("change.suffix")}
    return got.select("path", "known_version", "version", "kind", *(F.when(F.col("kind") == "delta", c).otherwise(0).alias(k) for k, c in parts.items()))


def delta_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of sources, each on the version that its doc_id names: only those on the newest one are taken."""
    d = _t(spark, sf, "documents")
    edits = d.select(F.col("source").alias("path"), F.col("doc_id").alias("base_version"), F.lit("x").alias("content"))
    done = deltas.write_delta(edits, d.select(F.col("source").alias("path"), F.col("doc_id").alias("version")))
    return done.groupBy("path", "accepted", "version").agg(F.count("*").alias("edits"))


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    """Customers say which market their nation serves; nations lie in regions."""
    c, n, r = (_t(spark, sf, t) for t in ("customer", "nation", "region"))
    said = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    serves = said.select(F.initcap("n_name").alias("subject"), F.lit("Serves market").alias("predicate"), F.col("c_mktsegment").alias("object"), F.lit("literal").alias("object_kind"), (F.lit(0.5) + F.col("c_custkey") % 5 / 10).alias("confidence"), (F.col("c_custkey") % 3).cast("string").alias("source"), F.col("c_custkey").alias("ts"))
    lies = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name"), F.lit("lies-in"), "r_name", F.lit("entity"), F.lit(None).cast("double"), F.lit("map"), F.col("n_nationkey") + 0)
    return serves.union(lies)


def merged_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.merge_facts(_triples(spark, sf))
    return f.select("fact_id", "s", "p", "o", "object_kind", F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"), "first_ts", "last_ts")


def merged_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.merge_entities(_triples(spark, sf))
    return e.select("entity", "name", F.array_join("aliases", ",").alias("aliases"), "first_ts", "last_ts")


def best_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The best facts for questions that name a nation and a region each."""
    t = _triples(spark, sf)
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    names = both.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array("n_name", "r_name")).alias("name"))
    return graph.query_facts(names, graph.merge_facts(t), graph.merge_entities(t), 5).select("query_id", "fact_id", "s", "p", "o", "score", "rank")


def halved_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All parts that halving leads to from parts whose key divides by 50."""
    p = _t(spark, sf, "part")
    half = F.floor(F.col("p_partkey") / 2)
    edges = p.where("p_partkey > 1").select(F.col("p_partkey").cast("long").alias("a"), half.alias("b"))
    return graph.closure(edges, p.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("long").alias("node")))


def edited_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Three edits of each part's lines, and an anchor that isn't there for every third part."""
    p = _t(spark, sf, "part")
    content = F.concat(F.lit("name: "), "p_name", F.lit("\nstruct Size {\n  "), F.col("p_size").cast("string"), F.lit("\n}\nend\n"))
    one = lambda kind, anchor, text: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor"), F.lit(text).alias("text"))
    edits = F.array(one("insert_before", F.lit("lines 1-1"), "top"), one("replace", F.lit("symbol struct Size"), "size"), one("insert_after", F.when(F.col("p_partkey") % 3 == 0, "no such line").otherwise("end"), "a\nb"))
    done = deltas.apply_edits(p.select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"), edits.alias("edits")))
    return done.select("path", "content", F.coalesce("error", F.lit("")).alias("error"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A Python file a supplier, which uses the Rust file of its nation and the file of the supplier before."""
    s, n = _t(spark, sf, "supplier"), _t(spark, sf, "nation")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("class Supplier"), key, F.lit(":\n    def of_"), key, F.lit("(self):\n        return Nation"), nation, F.lit("\n\ndef total_"), key, F.lit("():\n    return Supplier"), (F.col("s_suppkey") - 1).cast("string"), F.lit("()\n"))
    own = F.col("n_nationkey").cast("string")
    rust = F.concat(F.lit("pub struct Nation"), own, F.lit(" {\n}\npub fn region_"), own, F.lit("() {}\nenum Kind"), own, F.lit(" {}\n"))
    return s.select(F.concat(F.lit("s"), key, F.lit(".py")).alias("path"), text.alias("content")).union(n.select(F.concat(F.lit("n"), own, F.lit(".rs")), rust))


def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return code.symbols(_sources(spark, sf)).select("path", "line", "kind", "name")


def code_references(spark: SparkSession, sf: str) -> DataFrame:
    files = _sources(spark, sf)
    return code.references(files, code.symbols(files))


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    text = F.concat(F.lit("intro\n## Core Rules\nYou must sell "), "p_name", F.lit(".\n## Output-Format "), F.col("p_size").cast("string"), F.lit("\ndepends_on: Core Rules\nIn "), "p_type", F.lit("\n## Core Rules\nagain"))
    return p.select(F.col("p_partkey").alias("prompt_id"), text.alias("text"))


def prompt_sections(spark: SparkSession, sf: str) -> DataFrame:
    x = prompts.sections(_prompts(spark, sf))
    return x.select("prompt_id", "pos", "section_id", "name", "content", F.col("tokens").cast("long").alias("tokens"), F.array_join("topics", ",").alias("topics"), "priority", F.array_join("needs", ",").alias("needs"))


def keyword_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of each message's embedding by keywords that aren't 0."""
    x = retrieval.keyword_embedding(_t(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("at"), "text"), "at")
    cells = F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), F.round(v, 6).alias("v"))), lambda c: c["v"] > 0)
    return x.select("at.conv_id", "at.turn", F.explode(cells).alias("c")).select("conv_id", "turn", F.col("c.i").alias("cell"), F.col("c.v").alias("weight"))


def expanded_memory(spark: SparkSession, sf: str) -> DataFrame:
    """What the first turns of conversations whose id divides by 50 need of their conversation."""
    c = _t(spark, sf, "conversations")
    return memory.expand(c, c.where("conv_id % 50 = 0 and turn = 0").select(F.col("conv_id").alias("query_id"), "conv_id", "text"), k=2, base=1)


QUERIES = {f.__name__: f for f in (edited_parts, code_symbols, code_references, prompt_sections, keyword_vectors, expanded_memory, command_routes, dated_phrases, text_fields, asked_entities, delta_reads, delta_writes, merged_facts, merged_entities, best_facts, halved_parts)}


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _first(table: list[tuple[str, str]], c: str, otherwise: str) -> str:
    cases = " ".join(f"when regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}') then '{name}'" for name, p in table)
    return f"case {cases} else {otherwise} end"


_FILTERS = [(f.name, p) for f in FILTERS for p in f.commands]
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]{{1,4}}|[^\s\p{{L}}\p{{N}}]'))"
_LINES = r"case when {0} = '' then [] else string_split(regexp_replace(replace({0}, E'\r\n', E'\n'), E'\n$', ''), E'\n') end"
_KEPT = r"regexp_replace(lower(trim({0}, ' ')), '[^\p{{L}}\p{{N}}\s_-]', '', 'g')"
_ID = r"trim(regexp_replace(" + _KEPT + r", '\s+', ' ', 'g'), ' ')"
_PREDICATE = r"regexp_replace(" + _KEPT + r", '[\s-]+', '_', 'g')"
_DATES = {
    "yesterday": "'yesterday [' || strftime(d - 1, '%Y-%m-%d')", "Last Week": "'last week [week of ' || strftime(d - 7, '%Y-%m-%d')", "last month": "'last month [' || strftime(d - 30, '%B %Y')", "last year": "'last year [' || (year(d) - 1)",
    "this week": "'this week [week of ' || strftime(d, '%Y-%m-%d')", "THIS MONTH": "'this month [' || strftime(d, '%B %Y')", "today": "'today [' || strftime(d, '%Y-%m-%d')", "tomorrow": "'tomorrow [' || strftime(d + 1, '%Y-%m-%d')",
    "last friday": "'last Friday [' || strftime(d - ((isodow(d) + 2) % 7)::int, '%Y-%m-%d')", "recently": "'recently [around ' || strftime(d, '%Y-%m')",
}
_STEPS = ["' then '", "'after that'", "'step by step'", "'compare'", "'tradeoff'", "'architecture'"]
_HEAD = "substr(text, 1, 60)"


def _spaced(stop: list[str], most: int | None) -> str:
    """Distinct names among words that white space parts, in order."""
    low = ", ".join(f"'{w.lower()}'" for w in stop)
    all_ = rf"list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: strlen(w) >= 3 and regexp_matches(w, '^\p{{Lu}}') and lower(w) not in ({low})), lambda w: lower(w))"
    once = f"list_filter(list_transform({all_}, lambda x, i: case when list_position({all_}, x) = i then x end), lambda x: x is not null)"
    return once if most is None else f"({once})[1:{most}]"


_TRIPLES = """t as (select upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as subject, 'serves_market' as p, c_mktsegment as object, 'literal' as object_kind, 0.5 + (c_custkey % 5) / 10.0::double as confidence, (c_custkey % 3)::varchar as source, c_custkey::bigint as ts from customer join nation on c_nationkey = n_nationkey
union all select lower(n_name), 'lies_in', r_name, 'entity', 0.7, 'map', n_nationkey::bigint from nation join region on n_regionkey = r_regionkey),
x as (select *, lower(trim(subject, ' ')) as s, case when object_kind = 'entity' then lower(trim(object, ' ')) else trim(object, ' ') end as o from t),
f as (select substr(sha256(s || '|' || p || '|' || object_kind || ':' || lower(trim(o, ' '))), 1, 16) as fact_id, s, p, min_by(o, ts) as o, object_kind, max(confidence) as confidence, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, min(ts) as first_ts, max(ts) as last_ts from x group by fact_id, s, p, object_kind)"""

#: Cells of each message, and each message's vector: kw(conv_id, turn, cell, weight).
_CELLS = rf"""w as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as word from conversations),
d as (select word, (list_reduce(list_concat([0::hugeint], list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), (2 * i - 1)::bigint, 2))::hugeint)), lambda h, b: (h * {retrieval.HASH_FACTOR}::hugeint + b + {retrieval.HASH_OFFSET}::hugeint) % 18446744073709551616::hugeint) % {retrieval.KEYWORD_DIMS})::int as cell from (select distinct word from w)),
n as (select conv_id, turn, cell, count(*) as c from w join d using (word) group by all),
kw as (select conv_id, turn, cell, c / sqrt(sum(c * c) over (partition by conv_id, turn))::double as weight from n)"""


def _section_topics(c: str) -> str:
    parts = ", ".join(f"case when {' or '.join(f"contains(lower({c}), '{k}')" for k in words)} then '{t}' end" for t, words in SECTION_TOPICS.items())
    return f"coalesce(nullif(array_to_string(list_sort(list_filter([{parts}], lambda x: x is not null)), ','), ''), 'general')"


SQL = {
    "edited_parts": r"""select p_partkey::varchar as path, case when p_partkey % 3 = 0 then E'name: ' || p_name || E'\nstruct Size {\n  ' || p_size || E'\n}\nend\n' else E'top\nname: ' || p_name || E'\nsize\nend\na\nb\n' end as content, case when p_partkey % 3 = 0 then 'anchor not found' else '' end as error from part""",
    "code_symbols": "select 's' || s_suppkey || '.py' as path, line::int as line, kind, name || s_suppkey as name from supplier, (values (1, 'class', 'Supplier'), (2, 'method', 'of_'), (5, 'function', 'total_')) as v(line, kind, name) union all select 'n' || n_nationkey || '.rs', line, kind, name || n_nationkey from nation, (values (1, 'struct', 'Nation'), (3, 'function', 'region_'), (4, 'enum', 'Kind')) as v(line, kind, name)",
    "code_references": "select 's' || s_suppkey || '.py' as src, 'n' || s_nationkey || '.rs' as dst from supplier union select 's' || a.s_suppkey || '.py', 's' || b.s_suppkey || '.py' from supplier a join supplier b on b.s_suppkey = a.s_suppkey - 1",
    "prompt_sections": f"""with s as (select p_partkey::bigint as prompt_id, 0 as pos, 'core_rules' as section_id, 'Core Rules' as name, 'You must sell ' || p_name || '.' as content, 0 as priority, '' as needs from part
union all select p_partkey, 1, 'output_format_' || p_size, 'Output-Format ' || p_size, E'depends_on: Core Rules\\nIn ' || p_type, 2, 'core_rules' from part union all select p_partkey, 2, 'core_rules_2', 'Core Rules', 'again', 0, '' from part)
select prompt_id, pos::int as pos, section_id, name, content, {_TOKENS.format('content')}::bigint as tokens, {_section_topics('content')} as topics, priority::int as priority, needs from s""",
    "keyword_vectors": f"with {_CELLS} select conv_id, turn, cell, round(weight, 6) as weight from kw",
    "expanded_memory": f"""with {_CELLS}, q as (select conv_id, cell, weight from kw where conv_id % 50 = 0 and turn = 0),
s as (select m.conv_id, m.turn, round(coalesce(sum(kw.weight * q.weight), 0), 9) as score from (select conv_id, turn from conversations where conv_id in (select conv_id from conversations where conv_id % 50 = 0 and turn = 0)) m left join kw using (conv_id, turn) left join q on q.conv_id = kw.conv_id and q.cell = kw.cell group by all),
b as (select conv_id, turn from (select *, row_number() over (partition by conv_id order by score desc, turn) as i from s) where i <= 2),
r as (select conv_id, turn from (select conv_id, turn, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= greatest(1, floor(log2(n))) and conv_id in (select conv_id from s))
select conv_id as query_id, conv_id, turn from (select * from b union select * from r)""",
    "command_routes": f"""with c as (select p_partkey, {_quoted(COMMANDS)}[p_partkey % {len(COMMANDS)} + 1] || ' ' || p_partkey as c from part),
w as (select *, case when starts_with(trim(c, ' '), 'textloom') or contains(c, '<<') or contains(c, '|') or contains(c, '&&') then null else {_first(asking.WRAPPED, "trim(c, ' ')", "null")} end as rule from c)
select p_partkey, {_first(_FILTERS, 'c', "''")} as filter, {_first(asking.FAMILIES, 'c', "'generic'")} as family, rule, case when rule is null then c else 'textloom exec -- ' || trim(c, ' ') end as wrapped from w""",
    "dated_phrases": "select event_id, 'we met ' || case event_id % 10 " + " ".join(f"when {i} then {_DATES[p]}" for i, p in enumerate(PHRASES)) + " end || '], not yesterdays' as said from (select event_id, ts::date as d from events)",
    "text_fields": rf"""select doc_id, regexp_replace(regexp_replace(lower(trim({_HEAD}, ' ')), '[^\p{{L}}\p{{N}}]', '_', 'g'), '^_+|_+$', '', 'g') as section,
case when {_TOKENS.format('text')} > 80 or len(regexp_extract_all(text, '[,;:?!]')) >= 4 or {" or ".join(f"contains(lower(text), {s})" for s in _STEPS)} then 'complex' when {_TOKENS.format('text')} <= 20 and len(regexp_extract_all(text, '[,;:?!]')) <= 1 then 'simple' else 'medium' end as complexity,
case when length(text) <= 50 then text else substr(text, 1, 25) || E'\n...\n' || right(text, 25) end as bounded,
{_ID.format(_HEAD)} as entity_id, {_PREDICATE.format(_HEAD)} as predicate,
substr(sha256({_ID.format(_HEAD)} || '|is|literal:' || lower(trim({_HEAD}, ' '))), 1, 16) as fact_id,
round(least(greatest(coalesce(try_cast(regexp_extract(text, '[0-9]+([.][0-9]+)?', 0) as double) / 10, 0), 0), 1), 6) as score,
round(case when {_TOKENS.format('text')} = 0 then 1.0 else least({_TOKENS.format(_HEAD)} / {_TOKENS.format('text')}::double, 1.0) end, 6) as ratio from documents""",
    "asked_entities": rf"""with e as (select conv_id, turn, trim(text, ' ') as text, array_to_string({_spaced(HIT_STOP, 5)}, ',') as widened, len({_spaced(ASKING_STOP, None)}) as names, list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda w: w <> '') as w from conversations)
select conv_id, turn, widened, names::bigint as names, case when text = '' then false else {" or ".join(f"contains(lower(text), '{m}')" for m in asking.HOP_MARKERS)} or names >= 2 or len(w) > 14
or (len(w) >= 6 and len(list_filter(range(3, len(w)), lambda i: lower(w[i]) = 'and' and lower(w[i - 1]) not in {tuple(asking.FILLERS)} and lower(w[i + 1]) not in {tuple(asking.FILLERS)})) > 0) end as several from e""",
    "delta_reads": rf"""with l as (select source, max(doc_id) as version from documents group by source),
r as (select k.source as path, k.doc_id as known_version, l.version, k.text as old, c.text as text, case when sha256(c.text) = sha256(k.text) then 'unchanged' else 'delta' end as kind from documents k join l using (source) join documents c on c.doc_id = l.version where k.doc_id % 50 = 0),
n as (select *, {_LINES.format('old')} as a, {_LINES.format('text')} as b from r),
p as (select *, least(len(a), len(b)) as n, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0) - 1, least(len(a), len(b))) as pre from n),
s as (select *, coalesce(nullif(list_position(list_transform(range(1, n - pre + 1), lambda i: a[len(a) - i + 1] = b[len(b) - i + 1]), false), 0) - 1, n - pre) as suf from p)
select path, known_version, version, kind, case when kind = 'delta' then (pre)::int else 0 end as prefix, case when kind = 'delta' then (len(a) - pre - suf)::int else 0 end as removed, case when kind = 'delta' then (len(b) - pre - suf)::int else 0 end as inserted, case when kind = 'delta' then (suf)::int else 0 end as suffix from s""",
    "delta_writes": "select source as path, doc_id = m as accepted, case when doc_id = m then m + 1 else m end as version, count(*) as edits from (select source, doc_id, max(doc_id) over (partition by source) as m from documents) group by all",
    "merged_facts": f"with {_TRIPLES} select fact_id, s, p, o, object_kind, round(confidence, 6) as confidence, sources, first_ts, last_ts from f",
    "merged_entities": f"with {_TRIPLES}, e as (select s as entity, trim(subject, ' ') as name, ts from x union all select o, trim(object, ' '), ts from x where object_kind = 'entity') select entity, first(name order by ts, name) as name, array_to_string(list_sort(list_distinct(list(name))), ',') as aliases, min(ts) as first_ts, max(ts) as last_ts from e group by entity",
    "best_facts": f"""with {_TRIPLES}, a as (select n_nationkey as query_id, lower(n_name) as e from nation union select n_nationkey, lower(r_name) from nation join region on n_regionkey = r_regionkey),
h as (select query_id, fact_id, count(*) as overlap from (select distinct query_id, fact_id, e from a join f on s = e or (object_kind = 'entity' and o = e)) group by all),
g as (select *, min(last_ts) over (partition by query_id) as low, max(last_ts) over (partition by query_id) as high from h join f using (fact_id)),
c as (select *, confidence * case when high > low then 0.5 + 0.5 * (last_ts - low) / (high - low)::double else 1 end * (1 + overlap / 4.0) as score from g)
select query_id, fact_id, s, p, o, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from c) where rank <= 5""",
    "halved_parts": "with recursive r as (select p_partkey::bigint as node from part where p_partkey % 50 = 0 union select node // 2 from r where node > 1) select node from r",
}
