"""Fact tables of a code graph, derived from the star schema.

The tables at hand hold no source code, so queries run on facts computed from
them. A fact table is one SELECT in the SQL that Spark and DuckDB share; in
Spark it becomes the input of an operator, in an oracle a common table
expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FACTS: dict[str, str] = {
    # 25 repositories; every fourth has test types that are named after others
    "part_names": """
        select cast(p.p_partkey as bigint) k, cast(p.p_partkey % 25 as bigint) repository_id, p.p_type, p.p_size,
          replace(p.p_name, ' ', '_') || '_' || substring(p.p_brand, 7, 3) plain
        from part p
    """,
    "types": """
        select 'T' || cast(a.k as string) id, a.k, a.repository_id, 'src/main/java/r' || cast(a.repository_id as string) || '/T' || cast(a.k as string) || '.java' relative_path,
          case when a.k % 11 = 5 and b.plain is not null then b.plain || 'Test' else a.plain end simple_name,
          case when a.p_size % 5 = 0 then 'INTERFACE' when a.p_size % 17 = 1 then 'ENUM' else 'CLASS' end kind,
          case when a.k % 11 = 5 and b.plain is not null then 'TEST'
            else case a.p_type when 'ECONOMY' then 'CONTROLLER' when 'SMALL' then 'SERVICE' when 'STANDARD' then 'REPOSITORY' when 'PROMO' then 'REPOSITORY' when 'LARGE' then 'ENTITY' else 'COMPONENT' end
          end role
        from part_names a left join part_names b on b.k = a.k - 25
    """,
    "methods": """
        select 'M' || cast(o.o_orderkey as string) id, 'T' || cast(o.o_orderkey % n.n as string) parent_id, cast((o.o_orderkey % n.n) % 25 as bigint) repository_id,
          case substring(o.o_orderpriority, 1, 1) when '1' then 'find' when '2' then 'save' when '3' then 'load' when '4' then 'deleteAll' else 'count' end simple_name,
          case o.o_custkey % 3 when 0 then '()' when 1 then '(int)' else '(int,Map<K, V>)' end signature,
          case when o.o_custkey % 17 = 0 then 'TEST' end role, cast(o.o_orderkey % 400 + 1 as int) start_line
        from orders o cross join (select count(*) n from part) n
    """,
    "symbols": """
        select repository_id, id, cast(null as string) parent_id, kind, simple_name, 'app.' || simple_name qualified_name, cast(null as string) signature, role, relative_path, 1 start_line, 1 start_column, 600 end_line from types
        union all
        select m.repository_id, m.id, m.parent_id, 'METHOD', m.simple_name, 'app.' || t.simple_name || '.' || m.simple_name, m.signature, m.role, t.relative_path, m.start_line, 5, m.start_line + 5
        from methods m join types t on t.id = m.parent_id
    """,
    "type_refs": """
        select a.repository_id, a.id type_id, a.kind type_kind, r.ref_kind, r.position,
          case when r.position = 0 then b.simple_name when r.position = 1 then 'app.' || b.simple_name || '<X>[]' else 'JpaRepository' end text,
          case when r.position = 2 then b.simple_name else '' end type_arg, a.relative_path, 1 type_line, 1 type_column, 1 line, 20 + r.position "column"
        from types a join types b on b.k = a.k + 50
        join (select 'EXTENDS' ref_kind, 0 position union all select 'IMPLEMENTS', 1 union all select 'EXTENDS', 2) r
          on (r.position = 0 and a.k % 3 = 0) or (r.position = 1 and a.k % 4 = 0) or (r.position = 2 and a.role = 'REPOSITORY')
    """,
    "params": """
        select a.repository_id, a.id type_id, 'dep' || cast(d.d as string) name, d.d position, case when d.d = 2 then 'List<' || b.simple_name || '>' else 'x.y.' || b.simple_name end type_text,
          a.relative_path, 3 line, 10 * d.d "column"
        from types a join (select 1 d union all select 2 union all select 3) d on a.k % 4 < d.d join types b on b.k = a.k + 25 * d.d
    """,
    "fields": """
        select t.repository_id, t.id type_id, 'f' || cast(f.slot as string) name, g.simple_name || '<Y>' type_text
        from (
          select l.l_orderkey % n.n o, l.l_partkey % 40 slot, min(l.l_partkey - l.l_partkey % 25 + (l.l_orderkey % n.n) % 25) target
          from lineitem l cross join (select count(*) n from part) n group by l.l_orderkey % n.n, l.l_partkey % 40
        ) f join types t on t.k = f.o join types g on g.k = f.target
    """,
    "raw_calls": """
        select distinct cast((l.l_orderkey % n.n) % 25 as bigint) repository_id, 'T' || cast(l.l_orderkey % n.n as string) owner_id, 'M' || cast(l.l_orderkey as string) method_id,
          case l.l_linenumber when 1 then 'NONE' when 6 then 'THIS_FIELD' when 7 then 'OTHER' else 'NAME' end scope_kind,
          case when l.l_linenumber = 5 then g.simple_name when l.l_linenumber in (2, 3, 4, 6) then case when l.l_suppkey % 9 = 0 then 'dep1' else 'f' || cast(l.l_partkey % 40 as string) end end scope_name,
          case l.l_suppkey % 7 when 0 then 'find' when 1 then 'save' when 2 then 'load' when 3 then 'deleteAll' when 4 then 'count' when 5 then 'rare' else 'searchAll' end callee,
          cast(l.l_suppkey % 3 as int) arg_count, l.l_linenumber line, cast(floor(l.l_extendedprice) as int) "column"
        from lineitem l cross join (select count(*) n from part) n
        join types g on g.k = l.l_partkey - l.l_partkey % 25 + (l.l_orderkey % n.n) % 25
    """,
    "calls": """
        select c.repository_id, c.owner_id, m.simple_name method_name, case m.signature when '()' then 0 when '(int)' then 1 else 3 end method_arity, c.scope_kind, c.scope_name, c.callee, c.arg_count,
          coalesce(c.scope_name || '.', '') || c.callee || '(' || cast(c.arg_count as string) || ')' expr_text, t.relative_path, c.line, c."column"
        from raw_calls c join methods m on m.id = c.method_id join types t on t.id = c.owner_id
    """,
    "line_groups": """
        select l.l_orderkey % n.n o, l.l_linenumber % 3 slot, l.l_linestatus status, max(l.l_partkey - l.l_partkey % 25 + (l.l_orderkey % n.n) % 25) target, count(*) items
        from lineitem l cross join (select count(*) n from part) n group by l.l_orderkey % n.n, l.l_linenumber % 3, l.l_linestatus
    """,
    "edges": """
        select repository_id, source_id, target_id, kind, confidence, line, "column",
          source_id || '>' || target_id || ':' || kind || ':' || cast(line as string) || ':' || cast("column" as string) || ':' || cast(cast(round(confidence * 100) as int) as string) id
        from (
          select cast(g.o % 25 as bigint) repository_id, 'T' || cast(g.o as string) source_id, 'T' || cast(t.target as string) target_id,
            case (floor(t.target / 25) + g.slot) % 7 when 0 then 'INJECTS' when 1 then 'TESTS' when 2 then 'READS_ENTITY' when 3 then 'WRITES_ENTITY' when 4 then 'IMPLEMENTS' else 'CALLS' end kind,
            case g.items % 4 when 0 then 0.6 when 1 then 0.8 when 2 then 0.9 else 1.0 end confidence, cast(g.slot as int) line, case g.status when 'O' then 1 else 2 end "column"
          from line_groups g join (select o, slot, max(target) target from line_groups group by o, slot) t on t.o = g.o and t.slot = g.slot
        ) e
    """,
    "files": """
        select cast(doc_id % 25 as bigint) repository_id,
          case when doc_id % 7 = 0 then 'build/src/main/java/F' when doc_id % 7 = 1 then 'm' || cast(doc_id % 3 as string) || '/src/test/java/p/F' when doc_id % 7 = 2 then 'F'
            when doc_id % 7 = 3 then 'src/main/java/F' else 'm' || cast(doc_id % 5 as string) || '/src/main/java/p/q/F' end
            || cast(doc_id as string) || case when doc_id % 7 = 1 then 'Test' else '' end || case when doc_id % 13 = 6 then '.txt' else '.java' end relative_path,
          text content
        from documents
    """,
    "snapshot": """
        select repository_id, relative_path, case when doc % 6 = 5 then 'changed ' || content else content end content
        from (select cast(substring(relative_path, position('F' in relative_path) + 1, 1) as int) doc, repository_id, relative_path, content from files where relative_path like '%.java' and relative_path not like 'build%') f
        where doc <> 9
    """,
    "java_files": """
        select cast(repository_id as string) repository_id, relative_path, k, simple_name, kind, role, case when k % 50 = 7 then 1 else 0 end broken,
          'package app.r' || cast(repository_id as string) || ';' || chr(10)
          || '// {' || chr(10) || case role when 'CONTROLLER' then '@RestController @RequestMapping({"/c' || cast(k as string) || '/", "v" + "2"}) ' when 'SERVICE' then '@Service ' when 'REPOSITORY' then '@org.x.Repository ' when 'ENTITY' then '@Entity(name = "}") ' else '@Component ' end
          || 'public ' || case kind when 'INTERFACE' then 'interface ' when 'ENUM' then 'enum ' else 'abstract class ' end || simple_name || case when kind = 'CLASS' then ' extends Base<Integer, X>' else '' end || ' {' || chr(10)
          || case kind when 'ENUM' then '  A, B(1) { void no() { } };' || chr(10) else '' end
          || '  private static final Map<String, Dep' || cast(k % 5 as string) || '> dep = new HashMap<String, X>(), other[];' || chr(10)
          || '  protected ' || simple_name || '(@Q Dep dep, int... n) { dep.start(); }' || chr(10)
          || '  @GetMapping("/a") @Deprecated public List<String> find(@RequestBody final Body<A, B> b, int[] c) { return this.dep.load(b, c).map(x -> go(x, "(")); }' || chr(10)
          || case when k % 50 = 7 then '' else '}' || chr(10) end content
        from types
    """,
    "endpoints": """
        select m.repository_id, m.id method_id, m.parent_id type_id, t.relative_path, m.start_line, case m.simple_name when 'find' then 'GET' else 'POST' end http_method,
          '/' || t.simple_name || '/' || m.simple_name path, t.simple_name controller, m.simple_name method_name, 'E' || m.id id
        from methods m join types t on t.id = m.parent_id where t.role = 'CONTROLLER' and m.simple_name in ('find', 'save')
    """,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
_NAME = re.compile(r"\b(?:from|join)\s+(\w+)")


def needed(names: list[str], facts: dict[str, str] = FACTS) -> list[str]:
    """The facts and those they are made from, each after what it needs."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in _NAME.findall(facts[name]):
            if other in facts and other != name and other not in out:
                add(other)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def oracle(select: str, more: dict[str, str] | None = None) -> str:
    """A DuckDB query over facts, and over ``more`` steps made from them."""
    facts = FACTS | (more or {})
    used = needed([n for n in _NAME.findall(select) if n in facts], facts)
    return "with recursive " + ",\n".join(f"{n} as ({facts[n]})" for n in used) + "\n" + select if used else select


def fact(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fact table in Spark, over the Parquet tables of ``sf_dir`` and over facts that were ``written`` before."""
    facts = {n: select for n, select in FACTS.items() if n not in (written or {})}
    order = needed([name], facts)
    used = lambda t: any(re.search(rf"\b(?:from|join) {t}\b", facts[n]) for n in order)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if used(t)} | {n: df for n, df in (written or {}).items() if used(n)}
    text = "with " + ",\n".join(f"{n} as ({facts[n]})" for n in order) + f" select * from {name}"
    text = text.replace("{", "{{").replace("}", "}}")  # braces name tables below
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text.replace('"column"', "`column`"), **tables)
