"""Source-code tables that Spark writes from the benchmark tables.

Every customer becomes a module that exports a symbol, every order a module that imports and uses the
symbol of its customer, every nation a package. The code grows with the tables and nothing is
grouped, so a customer holding a third of all orders is a third of the files, never one file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import lexer
from factloom.session import dealt, scan

FILE_COLUMNS = ["path", "package", "text", "version"]


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


def customer_modules(spark: SparkSession, sf_dir: str, version: str = "head", deal: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """One exporting module per customer: function, interface, enum and constant.

    The base version is unedited. In the head version the last digit of the key decides the edit: 0 removes the
    interface, 1 adds a required parameter, 2 changes the return type, 3 adds and 4 removes an enum member, 5 adds
    an export, 6 makes a parameter required, 7 adds an optional parameter, 8 adds a required member, 9 nothing.
    ``deal`` places the keys before the texts are written.
    """
    t = deal(scan(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    edit = lambda d, new, old: f"if(c_custkey % 10 = {d}, {new}, {old})" if version == "edited" else old
    optional = edit(6, "''", "if(c_custkey % 2 = 0, '?', '')")
    more_params = edit(1, "', region: string'", edit(7, "', note?: string'", "''"))
    returns = edit(2, "'string'", "'number'")
    member = edit(8, "'vip: boolean; '", "''")
    interface = f"""concat('export interface Customer', c_custkey, 'Info {{ name: string; ', {member}, 'segment', if(c_custkey % 5 = 0, '?', ''), ': Segment; }}')"""
    return t.select(
        F.expr("concat('packages/nation', c_nationkey, '/src/customer', c_custkey, '.ts')").alias("path"),
        F.expr("concat('nation', c_nationkey)").alias("package"),
        F.expr(rf"""concat_ws('\n',
            'import {{ Segment }} from ''@shop/segments'';',
            '',
            concat('/** Looks up the balance of ', c_name, '. */'),
            concat('export ', if(c_custkey % 3 = 0, 'async ', ''), 'function customer', c_custkey,
                   '(status: string, priority', {optional}, ': string', {more_params}, '): ', {returns}, ' {{'),
            case c_custkey % 4 when 0 then '  try {{ return fetchBalance(status); }} catch (err) {{ return 0; }}'
                               when 1 then '  if (status) {{ return 1; }}'
                               when 2 then '  return () => stop();'
                               else '  for (const s of items) {{ await load(s); }}' end,
            '}}',
            '',
            {edit(0, "'// moved'", interface)},
            concat('// flag of segment ', c_mktsegment),
            concat('export const balance', c_custkey, ' = ', cast(cast(c_acctbal as bigint) as string), ';'),
            concat('export enum Level', c_custkey, ' {{ Low', {edit(4, "''", "', High'")}, if(c_custkey % 2 = 1, ', Top', ''), {edit(3, "', Extra'", "''")}, ' }}'),
            {edit(5, "concat('export const extra', c_custkey, ' = 1;')", "''")},
            concat('export function isInfo', c_custkey, '(x: unknown): x is Customer', c_custkey, 'Info {{ return typeof x === ''object''; }}'),
            '')""").alias("text"),
        F.lit(version).alias("version"),
        F.col("c_custkey").alias("key"),
    )


def order_modules(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """One using module per order. Status and priority decide the shape of its code."""
    o = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    t = deal(o.join(cust, "o_custkey"))
    return t.select(
        F.expr("concat('apps/app', o_orderkey % 25, '/src/order', o_orderkey, if(o_orderkey % 7 = 0, '.spec', ''), '.ts')").alias("path"),
        F.expr("concat('app', o_orderkey % 25)").alias("package"),
        F.expr(r"""concat_ws('\n',
            concat('import { customer', o_custkey, ' } from ''@shop/nation', c_nationkey, '/customer', o_custkey, ''';'),
            concat('import { Level', o_custkey, ' } from ''@shop/nation', c_nationkey, '/customer', o_custkey, ''';'),
            '',
            concat('export async function order', o_orderkey, '(status: string) {'),
            concat('  const region = process.env.REGION_', upper(substring(o_orderpriority, 1, 1)), ';'),
            case substring(o_orderpriority, 1, 1)
                when '1' then '  for (const s of items) { await load(s); }'
                when '2' then '  try { save(status); } catch (err) { report(err); }'
                when '3' then concat('  switch (level) { case Level', o_custkey, '.Low: break; case Level', o_custkey, '.High: break; }')
                when '4' then concat('  switch (level) { case Level', o_custkey, '.Low: break; default: break; }')
                else '  useEffect(() => { setCount(prev => prev + 1); return () => clear(); }, [status]);' end,
            concat('  return customer', o_custkey, '(', case o_orderstatus when 'F' then 'status'
                    when 'O' then 'status, region' else '' end, ');'),
            '}',
            if(o_orderkey % 10 = 0, concat('app.get(''/orders/', o_orderkey, ''', order', o_orderkey, ');'), ''),
            if(o_orderkey % 7 = 0, concat('describe(''order ', o_orderkey, ' totals'', () => { order', o_orderkey, '(); });'), ''),
            '')""").alias("text"),
        F.lit("head").alias("version"),
        F.col("o_orderkey").alias("key"),
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All generated modules."""
    return customer_files(spark, sf_dir).unionByName(order_files(spark, sf_dir))


def customer_files(spark: SparkSession, sf_dir: str, version: str = "head") -> DataFrame:
    rows = scan(spark, sf_dir, "customer").count()
    return customer_modules(spark, sf_dir, version, lambda keys: dealt(keys, rows)).drop("key")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark, sf_dir, "orders").count()
    return order_modules(spark, sf_dir, lambda keys: dealt(keys, rows)).drop("key")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package.json per nation."""
    return scan(spark, sf_dir, "nation").select(
        F.expr("concat('packages/nation', n_nationkey, '/package.json')").alias("path"),
        F.expr("""concat('{"name": "@shop/nation', n_nationkey, '", "scripts": {"build": "tsc"}}')""").alias("text"))


_KEPT: dict[tuple, DataFrame] = {}


def kept_tokens(spark: SparkSession, sf_dir: str, which: str, version: str = "head") -> DataFrame:
    """Token rows of a corpus, cut once per session and stored as a table in the shared folder.

    Stands for the token table a deployment stores next to its files. A token is a hundred times wider than what a fact reads of it:
    from the table a fact reads its columns only, and Spark plans joins by what was written, not by the size of the keys.
    """
    key = (spark.sparkContext.applicationId, sf_dir, which, version)
    if key not in _KEPT:
        files = {"customer": lambda: customer_files(spark, sf_dir, version), "order": lambda: order_files(spark, sf_dir)}[which]()
        _KEPT[key] = lexer.stored_tokens(files, f"{which}-tokens")
    return _KEPT[key]


def tokens_of(files: DataFrame) -> DataFrame:
    return lexer.tokens(files)
