"""Inputs of the registered queries: the given tables, or columns derived from them row by row.

The expressions are SQL that Spark and DuckDB both read, so that a query and its oracle start from the
same values. Every given row takes part; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

_K = "cast(c_custkey as string)"
_H = f"md5({_K})"
_PAD4 = "lpad(cast(c_custkey % 10000 as string), 4, '0')"
_PAD3 = "lpad(cast(c_custkey % 1000 as string), 3, '0')"
_SLASH = "chr(92)"

# One line of invented personal data per customer, with a value for every built-in rule.
CUSTOMER_TEXT = f"""concat(
  'Mail u', {_K}, '@example.com and u', {_K}, '@example.com or v', cast(c_nationkey as string), '@mail.example.org, ',
  'ssn ', {_PAD3}, '-12-', {_PAD4}, ' ü', {_PAD3}, '-45-', {_PAD4}, 'ß ',
  'card 4', {_PAD3}, '-', {_PAD4}, ' ', {_PAD4}, '-9', {_PAD3}, ' ',
  'call (', {_PAD3}, ') 555-', {_PAD4}, ' or +1-', {_PAD3}, '-555-', {_PAD4}, ' or 17', lpad({_K}, 8, '0'), ' ',
  case when c_custkey % 3 = 0 then concat('key sk-', {_H}, ' ghp_', {_H}, 'AbCd gho_', {_H}, 'AbCd ')
       when c_custkey % 3 = 1 then concat('key glpat-', substr({_H}, 1, 20), ' xoxb-', {_K}, '-', substr({_H}, 1, 8), ' ')
       else concat('key AIza', {_H}, 'x_Y ', upper(substr({_H}, 1, 20)), ':', {_H}, substr({_H}, 1, 8), ' ') end,
  'hash ', {_H}, {_H}, ' ',
  case when c_custkey % 2 = 0 then concat('pwd=u', {_K}, '@corp.example! ') else concat('Password : "p', {_K}, '" ') end,
  'in C:', {_SLASH}, 'Users', {_SLASH}, 'U', {_K}, {_SLASH}, 'f.txt and /home/u', {_K}, '/u', {_K}, '@x.example or /Users/u', {_K}, '/a ',
  'host 10.', cast(c_nationkey as string), '.0.', cast(c_custkey % 250 as string),
  ' 192.168.1.', cast(c_custkey % 250 as string), ' 172.', cast(c_custkey % 40 as string), '.0.7'
)"""
CUSTOMERS = f"select c_custkey, c_nationkey, c_mktsegment, {CUSTOMER_TEXT} as text from customer"

# Requests: every event is a request of the customer with the event's user id.
_USER = "concat('user', cast(user_id as string))"
_KN = "cast(substr(props, 7, length(props) - 7) as bigint)"
REQUESTS = f"""select event_id as request_id, ts, 'POST' as method,
  case when event_type = 'view' then '/v1/models' else '/v1/chat/completions' end as path,
  concat('10.0.', cast(user_id % 256 as string), '.', cast(event_id % 256 as string)) as source,
  case when event_id % 29 = 3 then cast(null as string)
       when event_id % 31 = 4 then concat('Basic ', {_USER})
       when event_id % 37 = 5 then 'Bearer wrong'
       when event_id % 2 = 0 then concat('bearer key-', {_USER}, '-0') else concat('Bearer key-', {_USER}, '-1') end as authorization,
  case when event_id % 5 = 0 then 'https://api.openai.com' when event_id % 5 = 1 then 'https://api.groq.com/openai'
       when event_id % 5 = 2 then 'http://localhost:11434' else 'https://internal.example' end as target,
  concat(event_type, ' ', props,
    case when event_id % 11 = 0 then concat(' mail ', {_USER}, '@example.com')
         when event_id % 13 = 0 then concat(' ssn ', lpad(cast(user_id % 1000 as string), 3, '0'), '-12-3456')
         when event_id % 17 = 0 then concat(' pwd=', {_USER}, ' ip 10.0.0.', cast(user_id % 250 as string)) else '' end) as body
  from events"""
# Responses: errors have no usage; the counts come from the event's value and its JSON property.
_IN = "cast(floor(value) as bigint) * 100"
RESPONSES = f"""select event_id as request_id,
  cast(case when event_type = 'error' then 503 when event_type = 'signup' then 404 else 200 end as int) as status,
  case when event_type = 'error' then 'upstream error'
       when event_id % 19 = 0 then '{{"usage":{{"prompt_tokens":1.5,"completion_tokens":7}}}}'
       else concat('{{"id":"[EMAIL_1]","usage":{{"prompt_tokens":', cast({_IN} as string), ',"completion_tokens":',
                   cast({_KN} as string), ',"total_tokens":1}}}}') end as body
  from events"""
# Usage rows as the oracles see them, straight from the columns.
USAGE = f"""select event_id as request_id, ts, concat('user', cast(user_id as string)) as user_name,
  {_IN} as input_tokens, {_KN} as output_tokens from events
  where event_type <> 'error' and event_id % 19 <> 0 and ({_IN} <> 0 or {_KN} <> 0)"""
SEGMENTS = "select concat('user', cast(c_custkey as string)) as user_name, c_mktsegment as seg from customer"
# Attempts: one to six tries per event on two targets; the last digit of a number decides each status.
TRY_STATUS = """cast(case (event_id * 7 + n * 3) % 10 when 0 then 200 when 1 then 503 when 2 then 429 when 3 then null
  when 4 then 500 when 5 then 502 when 6 then 404 when 7 then 504 when 8 then 503 else 429 end as int)"""
ATTEMPTS = f"""select event_id as request_id, cast(n / 4 as int) as target_ord,
  case when n < 4 then 'https://api.openai.com' else 'https://api.groq.com/openai' end as target,
  cast(n % 4 as int) as attempt, {TRY_STATUS} as status,
  case when (event_id * 7 + n * 3) % 10 = 3 then 'connection refused' end as error from """
ATTEMPTS_SPARK = ATTEMPTS + "(select event_id, explode(sequence(0, cast(event_id % 6 as int))) as n from events)"
ATTEMPTS_DUCK = (
    ATTEMPTS.replace("n / 4", "n // 4")
    + "(select event_id, unnest(range(0, cast(event_id % 6 as int) + 1)) as n from events)"
)
# Key per customer: live, revoked or expired, by customer number. Limits: 0 means none.
KEY_FIELDS = """concat('key-user', cast(c_custkey as string), '-', cast(j as string)) as token_key,
  (c_custkey % 10 = 7 and j = 1) as revoked,
  case when c_custkey % 9 = 4 then timestamp '2024-01-10 00:00:00' end as expires_at"""
LIMIT = "cast(case when c_custkey % 4 = 0 then 0 else 1 + c_custkey % 3 end as int)"

# Rows in a task: a scanned customer takes about a millisecond, an event or a user with keys some tens of microseconds.
CUSTOMER_ROWS = 5_000
EVENT_ROWS = 50_000
USER_ROWS = 50_000

BUDGETS = {"BUILDING": 0.5, "MACHINERY": 1.0, "AUTOMOBILE": 0.0}
BLOCKING = {"ssn": "BLOCK", "CREDIT_CARD": "block", "email": "weird"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose texts are to be scanned, in ``spark.sensitext.textPartitions`` parts if that is set.

    The small tables of the tests and the benchmark are files with one row group; larger ones need no setting.
    """
    parts = spark.conf.get("spark.sensitext.textPartitions", None)
    return spread(table(spark, sf_dir, name), int(parts) if parts else None, key)


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, rows: int) -> DataFrame:
    """A table of narrow rows that texts are made from, in tasks of about ``rows`` rows, one for every core at least.

    A file of a few megabytes is one task or a few, but the texts made of its rows and the scans of those take a
    hundred times as long as reading it. So the number of tasks goes by the rows, which the footers tell;
    ``spark.sensitext.textPartitions`` overrides it.
    """
    given = table(spark, sf_dir, name)
    parts = spark.conf.get("spark.sensitext.textPartitions", None)
    if parts is None:
        parts = max(spark.sparkContext.defaultParallelism, -(-given.count() // rows))
    return spread(given, int(parts), key)


def _derived(spark: SparkSession, sf_dir: str, name: str, sql: str, key: str | None = None, rows: int | None = None) -> DataFrame:
    # Braces of JSON literals are doubled: {src} alone stands for the given table.
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"from {name}", "from {src}")
    if rows:
        return spark.sql(text, src=dealt(spark, sf_dir, name, key, rows))
    return spark.sql(text, src=texts(spark, sf_dir, name, key) if key else table(spark, sf_dir, name))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "customer", CUSTOMERS, "c_custkey", CUSTOMER_ROWS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events", REQUESTS, "event_id", EVENT_ROWS)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events", RESPONSES, "event_id", EVENT_ROWS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events", ATTEMPTS_SPARK)


def usage_log(spark: SparkSession, sf_dir: str, answers: DataFrame | None = None) -> DataFrame:
    """Responses, or what was read from them, with ts, user and group (the market segment of the customer)."""
    log = _derived(
        spark, sf_dir, "events",
        "select event_id as request_id, ts, concat('user', cast(user_id as string)) as user from events",
    )
    segments = _derived(
        spark, sf_dir, "customer",
        "select concat('user', cast(c_custkey as string)) as user, c_mktsegment as `group` from customer",
    )
    answers = responses(spark, sf_dir) if answers is None else answers
    return answers.join(log, "request_id").join(segments, "user", "left")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user per customer with two keys each, in the nested registry form."""
    flat = _derived(
        spark, sf_dir, "customer",
        f"""select concat('id', cast(c_custkey as string)) as id, concat('user', cast(c_custkey as string)) as name,
            c_mktsegment as `group`, {LIMIT} as rate_limit, {KEY_FIELDS}, j
            from (select *, explode(sequence(0, 1)) as j from customer)""",
        "c_custkey", USER_ROWS,
    )
    token = F.struct(
        F.col("token_key").alias("key"), F.lit("api-key").alias("label"),
        F.lit("2023-01-01").cast("timestamp").alias("created_at"),
        F.col("expires_at").cast("timestamp").alias("expires_at"), "revoked",
    )
    return flat.groupBy("id", "name", "group", "rate_limit").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("j", token.alias("t")))), lambda x: x["t"]
        ).alias("tokens")
    ).select(
        "id", "name", F.lit(None).cast("string").alias("email"), "group", "rate_limit",
        F.lit("2023-01-01").cast("timestamp").alias("created_at"), "tokens",
    )
