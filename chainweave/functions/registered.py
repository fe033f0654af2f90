"""Functions that SQL text can call, over exon chains: sorted arrays of structs of s and e."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chainweave.operators.classify import code_steps, struct_sql

CHAIN = "array<struct<s:bigint,e:bigint>>"


def _code(**how) -> str:
    """A query over one row that makes the code's columns one after the other."""
    out = f"select {struct_sql('q_exons', '0', 'cast(null as string)')} as q, {struct_sql('r_exons', '0', 'cast(null as string)')} as r"
    made: list[str] = ["q", "r"]
    for step in code_steps(**how):
        kept = [c for c in made if c not in step]
        out = f"select {', '.join([*kept, *[f'{sql} as {name}' for name, sql in step.items()]])} from ({out})"
        made = [*kept, *step]
    return out


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session, and returns their names.

    - covered(exons): bases of a chain;
    - introns_of(exons): gaps between its exons;
    - shared_bases(a, b): bases that exons of both share;
    - class_code(q, r), strict_class_code(q, r): the code of a query chain against a reference chain, null for spans apart;
    - sub_chain(a, b): whether a's introns are a run of b's and a's ends stay in the exons beside it; one exon is no chain.
    """
    introns = "if(size({0}) > 1, transform(sequence(1, size({0}) - 1), i -> named_struct('s', {0}[i - 1].e + 1, 'e', {0}[i].s - 1)), cast(array() as " + CHAIN + "))"
    at = f"coalesce(array_position({introns.format('b')}, get({introns.format('a')}, 0)), 0)"
    run = f"slice({introns.format('b')}, cast({at} as int), size(a) - 1) = {introns.format('a')}"
    sub = f"if(size(a) > 1 and size(a) <= size(b) and {at} > 0, {run} and a[0].s >= get(b, cast({at} as int) - 1).s and a[size(a) - 1].e <= get(b, cast({at} as int) + size(a) - 2).e, false)"
    bodies = {
        f"covered(exons {CHAIN}) returns bigint": "aggregate(exons, 0L, (n, x) -> n + x.e - x.s + 1)",
        f"introns_of(exons {CHAIN}) returns {CHAIN}": introns.format("exons"),
        f"shared_bases(a {CHAIN}, b {CHAIN}) returns bigint": "aggregate(a, 0L, (n, x) -> n + aggregate(b, 0L, (m, y) -> m + greatest(0L, least(x.e, y.e) - greatest(x.s, y.s) + 1)))",
        f"class_code(q_exons {CHAIN}, r_exons {CHAIN}) returns string": f"select code from ({_code()})",
        f"strict_class_code(q_exons {CHAIN}, r_exons {CHAIN}) returns string": f"select code from ({_code(strict=True)})",
        f"sub_chain(a {CHAIN}, b {CHAIN}) returns boolean": sub,
    }
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [h.split("(")[0] for h in bodies]
