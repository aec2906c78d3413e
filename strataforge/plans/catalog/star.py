"""Queries for roles, keys, star joins, masking and other column work."""

from functools import reduce

from pyspark.sql import DataFrame, Row, functions as F, types as T

from strataforge.functions import masking
from strataforge.operators import schema, star
from strataforge.operators.schema import Contract
from strataforge.plans.catalog.audits import EVENT_CONTRACT, PROPS_CONTRACT, event_payloads
from strataforge.plans.catalog.common import AS_OF, shown
from strataforge.plans.registry import half_up, query

FACT_SQL = """SELECT order_id, count(*) AS lines__record_count, CAST(sum(quantity) AS BIGINT) AS lines__sum__quantity,
  avg(quantity) AS lines__avg__quantity, CAST(sum(amount) AS BIGINT) AS lines__sum__amount, avg(amount) AS lines__avg__amount
  FROM v_context_lines GROUP BY order_id"""


@query("A5_aggregate_fact", FACT_SQL)
def a5(t):
    return star.aggregate_fact(t.v_context_lines, "lines", ["order_id"])


def profile_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_values,
        count(*) - count({c}) AS null_values, count(DISTINCT {c}) / count(*) AS unique_ratio, count({c}) / count(*) AS non_null_ratio FROM {table}"""
        for c in columns
    )


PROFILED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_size"]}


@query("A6_profile_columns", " UNION ALL ".join(profile_sql(n, c) for n, c in PROFILED.items()))
def a6(t):
    parts = [
        star.profile_columns(getattr(t, name), columns).withColumn("table_name", F.lit(name)).drop("ordinal")
        for name, columns in PROFILED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


KEY_TABLES = ("customer", "nation", "lineitem")


def key_sql(table, columns):
    """Evidence of single candidates in their rank order."""
    n = len(columns)
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, {half_up(f'u', 6)} AS unique_ratio, {half_up(f'f', 6)} AS non_null_ratio,
        {half_up(f'0.70::DOUBLE * u + 0.20::DOUBLE * f + 0.10::DOUBLE * {(n - i) / n!r}::DOUBLE', 6)} AS score
        FROM (SELECT count(DISTINCT {c}) / count(*) AS u, count({c}) / count(*) AS f FROM {table})"""
        for i, c in enumerate(columns)
    )


KEY_COLUMNS = {
    "customer": ["c_nationkey", "c_name", "c_mktsegment", "c_custkey", "c_acctbal"],
    "nation": ["n_regionkey", "n_nationkey", "n_name"],
    "lineitem": [
        "l_tax", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_partkey",
        "l_orderkey", "l_linestatus", "l_linenumber", "l_extendedprice", "l_discount",
    ],
}


@query("D8_infer_business_key", " UNION ALL ".join(key_sql(n, c) for n, c in KEY_COLUMNS.items()))
def d8(t):
    frames = []
    for name in KEY_TABLES:
        evidence = star.single_key_evidence(getattr(t, name))
        numbers = [F.round(c, 6).alias(c) for c in ("unique_ratio", "non_null_ratio", "score")]
        frames.append(evidence.select(F.lit(name).alias("table_name"), "column_name", *numbers))
    return reduce(DataFrame.unionByName, frames)


@query(
    "D8_pair_evidence",
    """SELECT first_column, second_column, count(*) AS row_count, count(DISTINCT (a, b)) AS distinct_pairs,
         count(DISTINCT (a, b)) / count(*) AS unique_ratio
       FROM (SELECT 'l_linenumber' AS second_column, 'l_orderkey' AS first_column, l_orderkey AS a, l_linenumber AS b FROM lineitem
             UNION ALL SELECT 'l_linenumber', 'l_partkey', l_partkey, l_linenumber FROM lineitem
             UNION ALL SELECT 'l_orderkey', 'l_partkey', l_partkey, l_orderkey FROM lineitem)
       GROUP BY ALL""",
)
def d8_pairs(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return star.pair_evidence(lines).drop("ordinal", "incomplete")


CONTEXT = {"orders": "v_context_orders", "lines": "v_context_lines", "customers": "v_context_customers"}
CONTEXT_ORDER = {"orders": ["total_amount"], "customers": ["customer_name"], "lines": ["quantity"]}


@query(
    "D9_plan_star",
    """SELECT entity, role, join_columns, containment FROM (
      SELECT 'orders' AS entity, 'anchor' AS role, 'order_id' AS join_columns, CAST(NULL AS DOUBLE) AS containment
      UNION ALL SELECT 'customers', 'dimension', 'customer_id', NULL
      UNION ALL SELECT 'lines', 'fact', 'order_id', (SELECT count(o.order_id) / count(*) FROM (SELECT DISTINCT order_id FROM v_context_lines) l
          LEFT JOIN (SELECT DISTINCT order_id FROM v_context_orders) o ON l.order_id = o.order_id))""",
)
def d9(t):
    frames = {name: getattr(t, view) for name, view in CONTEXT.items()}
    plan = star.star_plan(t.spark, [star.infer_key(df, name) for name, df in sorted(frames.items())])
    (anchor,) = star.role_rows(plan, "anchor")
    none = t.spark.range(1).select(F.lit(None).cast("double").alias("containment"))
    rows = []
    for link in plan:
        fact = link.role == "fact"
        share = star.key_containment(frames[link.entity], frames[anchor.entity], link.join_columns) if fact else none
        named = [F.lit(link.entity).alias("entity"), F.lit(link.role).alias("role"), F.lit("|".join(link.join_columns)).alias("join_columns")]
        rows.append(share.select(*named, "containment"))
    return reduce(DataFrame.unionByName, rows)


STAR_SQL = f"""WITH f AS ({FACT_SQL})
  SELECT o.customer_id, o.order_id, o.status, o.total_amount, c.customer_name AS customers__customer_name, c.segment AS customers__segment,
    f.* EXCLUDE (order_id) FROM v_context_orders o LEFT JOIN f ON o.order_id = f.order_id
    LEFT JOIN v_context_customers c ON o.customer_id = c.customer_id"""


@query("J3_star_join", STAR_SQL)
def j3(t):
    joins = {"orders": ("anchor", ["order_id"]), "customers": ("dimension", ["customer_id"]), "lines": ("fact", ["order_id"])}
    plan = [Row(entity=name, role=role, join_columns=columns) for name, (role, columns) in joins.items()]
    return star.star_join({n: getattr(t, v) for n, v in CONTEXT.items()}, plan, tie_break=CONTEXT_ORDER)


@query(
    "D10_context_gold",
    """WITH l AS (SELECT order_id, quantity, amount FROM (SELECT DISTINCT * FROM v_context_lines)
         QUALIFY row_number() OVER (PARTITION BY order_id, return_flag ORDER BY quantity DESC, amount DESC, return_flag DESC) = 1),
       f AS (SELECT order_id, count(*) AS lines__record_count, CAST(sum(quantity) AS BIGINT) AS lines__sum__quantity,
         CAST(sum(amount) AS BIGINT) AS lines__sum__amount FROM l GROUP BY order_id)
       SELECT o.order_id, o.status, o.total_amount, c.segment AS customers__segment, f.* EXCLUDE (order_id), 'sales' AS _context_id
       FROM v_context_orders o LEFT JOIN f ON o.order_id = f.order_id LEFT JOIN v_context_customers c ON o.customer_id = c.customer_id""",
)
def d10(t):
    # one line per order and flag, so that the lines have a key of their own to be merged on
    lines = t.v_context_lines.distinct()
    one = star.dedup_latest(lines, ["order_id", "return_flag"], ["quantity", "amount"])
    line_rows = one.withColumn("line_id", F.concat_ws("-", F.col("order_id"), F.col("return_flag")))
    sources = {"orders": t.v_context_orders, "customers": t.v_context_customers, "lines": line_rows}
    gold, _, _ = star.context_gold(sources, "sales", tie_break={"lines": ["amount"]})
    return gold.select(
        "order_id", "status", "total_amount", "customers__segment", "lines__record_count",
        "lines__sum__quantity", "lines__sum__amount", "_context_id",
    )


# keys, numbers and texts of the tables; a text is a metric only when it holds numbers
ROLE_TABLES = {
    "region": ("r_regionkey", "", "r_name"),
    "nation": ("n_nationkey", "n_regionkey", "n_name"),
    "customer": ("c_custkey", "c_nationkey c_acctbal", "c_name c_mktsegment"),
    "supplier": ("s_suppkey", "s_nationkey s_acctbal", "s_name"),
    "part": ("p_partkey", "p_size p_retailprice", "p_name p_brand p_type"),
    "orders": ("o_orderkey", "o_custkey o_totalprice", "o_orderstatus o_orderpriority"),
    "events": ("event_id user_id", "value", "event_type props"),
    "documents": ("doc_id", "n_chars", "text lang source"),
    "pages": ("page_id", "", "url html"),
    "conversations": ("conv_id", "turn", "role text"),
    "lineitem": ("l_orderkey", "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "l_returnflag l_linestatus"),
    "embeddings": ("vec_id", "label", ""),
    "benchmark": ("item_id", "", "text"),
    "labels": ("doc_id", "quality toxic", ""),
}
TIME_COLUMNS = {"orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate", "embeddings": "embedding"}  # and others that are neither number nor text
CHANGED = "CASE WHEN o_orderkey % 2 = 0 THEN ' 12.50 ' ELSE 'n/a' END"


def roles_sql():
    parts = []
    for table, (keys, numbers, texts) in ROLE_TABLES.items():
        fixed = [(c, "key") for c in keys.split()] + [(c, "dimension") for c in keys.split()]
        fixed += [(c, "metric") for c in numbers.split()]
        fixed += [(TIME_COLUMNS[table], "dimension")] if table in TIME_COLUMNS else []
        parts += [f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{role}' AS role" for c, role in fixed]
        parts += [
            f"""SELECT '{table}', '{c}', CASE WHEN bool_or(regexp_matches({c}, '^ *-?[0-9]+([.][0-9]+)? *$')) THEN 'metric' ELSE 'dimension' END FROM {table}"""
            for c in texts.split()
        ]
    parts.append(
        f"""SELECT 'orders', 'amount_text', CASE WHEN bool_or(regexp_matches({CHANGED}, '^ *-?[0-9]+([.][0-9]+)? *$')) THEN 'metric' ELSE 'dimension' END FROM orders"""
    )
    parts += ["SELECT 'orders', 'modified_on', 'updated_at'", "SELECT 'orders', 'modified_on', 'dimension'"]
    return " UNION ALL ".join(parts)


@query("P15_profile_roles", roles_sql())
def p15(t):
    """Roles of the columns of all tables; orders get a number in text and a change date as well."""
    rows = []
    for name in ROLE_TABLES:
        df = getattr(t, name)
        if name == "orders":
            df = df.withColumns({"AmountText": F.expr(CHANGED), "modified on": F.date_format("o_orderdate", "yyyy-MM-dd")})
        roles = star.profile_roles(df)
        for role, columns in (("key", roles.keys), ("metric", roles.metrics), ("dimension", roles.dimensions)):
            rows += [(name, c, role) for c in columns]
        if roles.updated_at:
            rows.append((name, roles.updated_at, "updated_at"))
    return t.spark.createDataFrame(rows, "table_name string, column_name string, role string")


# columns of uploads, as they would come from reading headers: one upload per supplier,
# its columns chosen by the parts it delivers
UPLOAD_COLUMNS = [*EVENT_CONTRACT.source_fields, *star.KPI_COLUMNS, "price", "colour", "weight"]
UPLOADS = f"""SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'kpi_' ELSE 'upload_' END || l_suppkey AS table_name,
  CASE {' '.join(f"WHEN l_partkey % 40 = {i} AND (l_suppkey + {i}) % 3 <> 0 THEN '{c}'" for i, c in enumerate(UPLOAD_COLUMNS))}
  ELSE 'c' || (l_partkey % 40) END AS column_name FROM lineitem"""


def _listed(columns):
    return ", ".join(f"'{c}'" for c in columns)


@query(
    "P16_match_known_schema",
    f"""WITH u AS (SELECT DISTINCT * FROM ({UPLOADS})),
      n AS (SELECT table_name, count(*) FILTER (column_name IN ({_listed(star.KPI_COLUMNS)})) AS kpi_columns,
        greatest(count(*) FILTER (column_name IN ({_listed(EVENT_CONTRACT.source_fields)})),
                 count(*) FILTER (column_name IN ({_listed(EVENT_CONTRACT.canonical_fields)}))) AS fields FROM u GROUP BY table_name)
      SELECT table_name, kpi_columns, CASE WHEN fields >= 0.7 * 4 THEN 'events' END AS contract,
        CASE WHEN kpi_columns >= 3 OR (table_name LIKE '%kpi%' AND kpi_columns >= 1) THEN 'legacy_kpi'
             WHEN fields >= 0.7 * 4 THEN 'registered_api' ELSE 'generic_dynamic' END AS route FROM n""",
)
def p16(t):
    contracts = {"events": (EVENT_CONTRACT.source_fields, EVENT_CONTRACT.canonical_fields)}
    return star.match_schema(t.sql(UPLOADS), contracts)


@query(
    "P17_prefix_entity_columns",
    "SELECT c_custkey, c_name AS customer__c_name, c_mktsegment AS customer__c_mktsegment FROM customer",
)
def p17(t):
    customer = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("_airbyte_raw_id"))
    return schema.prefix_columns(customer, "customer", ["c_custkey"], star.TECHNICAL_PREFIXES)


@query(
    "P1_standardize_columns",
    "SELECT c_custkey AS ma_khach_hang, c_name AS customer_name, c_nationkey AS quoc_gia_id, c_mktsegment AS duong_dan FROM customer",
)
def p1(t):
    odd = t.customer.select(
        F.col("c_custkey").alias("Mã Khách Hàng"),
        F.col("c_name").alias("CustomerName"),
        F.col("c_nationkey").alias("Quốc-Gia ID"),
        F.col("c_mktsegment").alias(" Đường__Dẫn "),
    )
    return schema.standardize_columns(odd)


@query("P2_apply_column_mapping", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey FROM supplier")
def p2(t):
    mapping = {"S Suppkey": "supplier_id", "s_name": "SupplierName", "s_nationkey": "s_nationkey", "absent": "x"}
    return schema.apply_mapping(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), mapping)


ORDER_CONTRACT = Contract(
    dataset="orders",
    schema_version="1.0",
    source=T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.LongType()),
            T.StructField("o_orderstatus", T.StringType()),
            T.StructField("o_orderdate", T.TimestampType()),
        ]
    ),
    canonical={"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "status", "o_orderdate": "changed_at"},
    key=("order_id",),
    record_id="o_orderkey",
    updated_at="o_orderdate",
    system="shop",
)
ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'"""
META_SQL = f"""'shop' AS _source_system, 'API' AS _source_type, 'orders' AS _dataset, '1.0' AS _schema_version, 'FULL' AS _ingestion_mode,
  'b1' AS _batch_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS _source_updated_at, '2024-03-01 00:00:00.000000' AS _ingested_at,
  sha256({ORDER_JSON}) AS _record_checksum"""


def order_records(t) -> DataFrame:
    return t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@query(
    "P3_to_canonical",
    f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS changed_at, {META_SQL} FROM orders""",
)
def p3(t):
    stamped = schema.stamp(order_records(t), ORDER_CONTRACT, "b1", AS_OF)
    return shown(schema.to_canonical(stamped, ORDER_CONTRACT))


@query(
    "P7_stamp_metadata",
    f"SELECT o_orderkey, {META_SQL} FROM orders",
)
def p7(t):
    stamped = schema.stamp(order_records(t), ORDER_CONTRACT, "b1", AS_OF)
    return shown(stamped.drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice"))


@query(
    "P5_preserve_extra_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS a_kind,
         CASE WHEN event_id % 3 = 0 THEN user_id END AS z_user FROM events""",
)
def p5(t):
    return schema.with_extra_fields(event_payloads(t), "payload", PROPS_CONTRACT)


@query(
    "P6_evolve_schema",
    """SELECT c_custkey, c_name, CAST(NULL AS BIGINT) AS points, CAST(NULL AS VARCHAR) AS price, CAST(NULL AS DOUBLE) AS ratio FROM customer""",
)
def p6(t):
    target = t.customer.select("c_custkey", "c_name", F.lit("old").alias("_legacy"))
    incoming = t.customer.select(
        F.col("c_custkey").alias("C_CUSTKEY"),
        F.lit(1).cast("bigint").alias("points"),
        F.lit(1).cast("decimal(9,2)").alias("price"),
        F.lit(1).cast("float").alias("Ratio"),
    )
    return schema.evolve(target, incoming, drop=["_legacy"])


CONTACTS = {
    "email": "CASE WHEN c_custkey % 7 = 0 THEN 'no mail' ELSE lower(c_mktsegment) || c_custkey || '@mail.example.com' END",
    "phone": "CASE WHEN c_custkey % 11 = 0 THEN '12' ELSE '+84 90 ' || (1000000 + c_custkey) END",
    "card_no": "'4111 1111 1111 ' || (1000 + c_custkey % 9000)",
    "passport": "'P' || c_custkey",
    "auth_key": "'secret' || c_custkey",
    "updated_date": "TIMESTAMP '2024-01-01 00:00:00'",
}


def contacts(t) -> DataFrame:
    columns = ", ".join(f"{text} AS {name}" for name, text in CONTACTS.items())
    return t.sql(f"SELECT c_custkey, c_name, {columns} FROM customer")


CONTACT_SQL = "c AS (SELECT c_custkey, c_name, " + ", ".join(f"{v} AS {k}" for k, v in CONTACTS.items()) + " FROM customer)"


@query(
    "P13_mask_columns",
    f"""WITH {CONTACT_SQL} SELECT c_custkey, CASE WHEN contains(email, '@') THEN left(email, 2) || '***@' || split_part(email, '@', 2) ELSE '***@masked.com' END AS email,
        CASE WHEN length(phone) >= 4 THEN '***-***-' || right(phone, 4) ELSE '***' END AS phone,
        '****-****-****-' || right(card_no, 4) AS card_no, md5(passport) AS passport, CAST(NULL AS VARCHAR) AS c_name FROM c""",
)
def p13(t):
    rules = {
        "email": "MASK_EMAIL", "phone": "MASK_PHONE", "card_no": "MASK_CARD",
        "passport": "MD5_HASH", "auth_key": "EXCLUDE", "updated_date": "EXCLUDE", "c_name": "NULL_OUT",
    }
    return masking.mask(contacts(t), rules)


@query(
    "P13_mask_columns_short",
    f"""WITH {CONTACT_SQL} SELECT c_custkey, CASE WHEN instr(email, '@') > 1 THEN left(email, 1) || '***@***.com' ELSE '***@***.com' END AS email,
        CASE WHEN length(phone) >= 4 THEN left(phone, 3) || '****' || right(phone, 2) ELSE '***' END AS phone,
        '****-****-****-' || right(card_no, 4) AS card_no FROM c""",
)
def p13_short(t):
    rules = {"email": "MASK_EMAIL", "phone": "MASK_PHONE", "card_no": "MASK_CARD"}
    return masking.mask(contacts(t).select("c_custkey", *rules), rules, "short")


@query(
    "P14_classify_columns",
    f"""WITH {CONTACT_SQL} SELECT ordinal, "column", sensitive, mask, is_cursor, email_share, phone_share, card_share FROM (VALUES
        (1, 'c_custkey', false, 'NONE', false), (2, 'c_name', false, 'NONE', false), (3, 'email', true, 'MASK_EMAIL', false),
        (4, 'phone', true, 'MASK_PHONE', false), (5, 'card_no', true, 'MASK_CARD', false), (6, 'passport', true, 'MD5_HASH', false),
        (7, 'auth_key', true, 'EXCLUDE', false), (8, 'updated_date', false, 'NONE', true)) AS v(ordinal, "column", sensitive, mask, is_cursor)
      LEFT JOIN (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{n}' AS n, avg(regexp_matches({n}, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}$')::INT) AS email_share, avg(regexp_matches({n}, '^\\+?[0-9][0-9 .()-]{{6,18}}[0-9]$')::INT) AS phone_share, avg(regexp_matches({n}, '^(?:[0-9]{{4}}[ -]?){{3}}[0-9]{{4}}$')::INT) AS card_share FROM c" for n in ('c_name', 'email', 'phone', 'card_no', 'passport', 'auth_key'))})) AS m ON m.n = "column" """,
)
def p14(t):
    return masking.classify_columns(contacts(t))


@query(
    "P18_search_rows",
    """SELECT p_partkey, p_name, p_brand FROM (SELECT p_partkey, p_name, p_brand FROM part
        WHERE lower(concat_ws(chr(31), CAST(p_partkey AS VARCHAR), p_name, p_brand)) LIKE '%ring%') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20""",
)
def p18(t):
    return schema.search(t.part.select("p_partkey", "p_name", "p_brand"), "RING", ["p_name", "p_partkey"], page=2)


@query(
    "P19_preview",
    """SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_rows
       FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
)
def p19(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    return schema.preview(rows, 50, order, {"o_orderstatus": "F"}).drop("o_orderdate")


@query(
    "P19_distinct_units",
    "SELECT DISTINCT n_nationkey AS unit, n_name AS label FROM nation JOIN customer ON c_nationkey = n_nationkey ORDER BY ALL",
)
def p19_units(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return schema.distinct_units(named.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("label")), "unit", "label")
