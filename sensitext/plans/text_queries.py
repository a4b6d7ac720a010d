"""Registered queries over texts: detection, redaction, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import BUILTIN, Rule, Rules
from ..operators import detect, policy, tokens
from . import inputs, sql
from .inputs import customers, table, texts
from .registered import query

DOCS = "select doc_id, text, lang, source from documents"
PAGES = "select page_id, html as text from pages"
SPANS = 'start, stop as "end", type, value'
# A customer's text has a value for nearly every rule.
DENSE = Rules().in_batches()

# A short name for each built-in rule, in rule order.
RULE_NAMES = (
    "ssn", "credit_card", "email", "phone", "api_key_sk", "api_key_ghp", "api_key_gho", "api_key_glpat",
    "api_key_xoxb", "api_key_aiza", "api_key_pair", "secret", "password", "path_windows", "path_unix",
    "ip_10", "ip_192", "ip_172",
)


def _rule_query(name: str, rules: Rules) -> None:
    @query(
        f"pii_{name}_findings",
        f"with {sql.found(inputs.CUSTOMERS, 'c_custkey', rules)} select c_custkey, {SPANS} from found",
    )
    def run(spark, sf_dir):
        return detect.findings(customers(spark, sf_dir), ["c_custkey"], rules=rules.in_batches())


for _name, _rule in zip(RULE_NAMES, BUILTIN):
    _rule_query(_name, Rules(rules=(_rule,)))


@query("pii_findings_customers", f"with {sql.found(inputs.CUSTOMERS, 'c_custkey')} select c_custkey, {SPANS} from found")
def pii_findings_customers(spark, sf_dir):
    return detect.findings(customers(spark, sf_dir), ["c_custkey"], rules=DENSE)


@query("pii_findings_documents", f"with {sql.found(DOCS, 'doc_id')} select doc_id, {SPANS} from found")
def pii_findings_documents(spark, sf_dir):
    return detect.findings(texts(spark, sf_dir, "documents", "doc_id"), ["doc_id"])


@query("pii_findings_pages", f"with {sql.found(PAGES, 'page_id')} select page_id, {SPANS} from found")
def pii_findings_pages(spark, sf_dir):
    return detect.findings(texts(spark, sf_dir, "pages", "page_id"), ["page_id"], text="html")


@query(
    "pii_findings_before_overlap_removal",
    f"""with {sql.matches(inputs.CUSTOMERS, 'c_custkey', Rules())}
    select c_custkey, start, stop as "end", arg_min(type, ord) as type, value from raw group by c_custkey, start, stop, value""",
)
def pii_findings_before_overlap_removal(spark, sf_dir):
    scanned = detect.scan(customers(spark, sf_dir), rules=DENSE, overlaps=True)
    return scanned.select("c_custkey", F.explode("matches").alias("m")).select("c_custkey", "m.*")


@query(
    "pii_byte_offsets",
    f"""with {sql.found(DOCS, 'doc_id')} select f.doc_id, f.start, f.stop as "end", f.type, f.value,
    cast(strlen(substr(s.text, 1, f.start)) as integer) as start_byte,
    cast(strlen(substr(s.text, 1, f.stop)) as integer) as end_byte from found f join src s on s.doc_id = f.doc_id""",
)
def pii_byte_offsets(spark, sf_dir):
    return detect.findings(texts(spark, sf_dir, "documents", "doc_id"), ["doc_id"], byte_offsets=True)


@query(
    "pii_types_per_doc",
    f"""with {sql.found(DOCS, 'doc_id')}, firsts as (select doc_id, type, min(start) as pos from found group by doc_id, type),
    kinds as (select doc_id, string_agg(type, ',' order by pos) as types from firsts group by doc_id)
    select s.doc_id, coalesce(k.types, '') as types from src s left join kinds k on k.doc_id = s.doc_id""",
)
def pii_types_per_doc(spark, sf_dir):
    typed = detect.pii_types(texts(spark, sf_dir, "documents", "doc_id"))
    return typed.select("doc_id", F.array_join("types", ",").alias("types"))


_COUNTS = "cast(count(*) as bigint) as findings, count(distinct value) as distinct_values"


def _counts_query(name: str, by: str) -> None:
    @query(
        name,
        f"""with {sql.found(DOCS, 'doc_id')} select s.{by}, f.type, {_COUNTS}
        from found f join src s on s.doc_id = f.doc_id group by s.{by}, f.type""",
    )
    def run(spark, sf_dir):
        return detect.pii_counts(texts(spark, sf_dir, "documents", "doc_id"), [by])


_counts_query("pii_counts_by_lang", "lang")
_counts_query("pii_counts_by_source", "source")


@query("pii_counts_documents", f"with {sql.found(DOCS, 'doc_id')} select type, {_COUNTS} from found group by type")
def pii_counts_documents(spark, sf_dir):
    return detect.pii_counts(texts(spark, sf_dir, "documents", "doc_id"))


@query(
    "pii_counts_benchmark",
    f"""with {sql.found("select item_id, text from benchmark", 'item_id')}
    select (select count(*) from src) as texts, (select count(*) from found) as findings""",
)
def pii_counts_benchmark(spark, sf_dir):
    scanned = detect.scan(table(spark, sf_dir, "benchmark"))
    return scanned.agg(F.count("*").alias("texts"), F.sum(F.size("matches")).cast("bigint").alias("findings"))


@query(
    "pii_vs_labels",
    f"""with {sql.found(DOCS, 'doc_id')}, hits as (select distinct doc_id from found)
    select l.quality, l.toxic, count(*) as docs, count(h.doc_id) as with_findings
    from labels l join src s on s.doc_id = l.doc_id left join hits h on h.doc_id = l.doc_id group by l.quality, l.toxic""",
)
def pii_vs_labels(spark, sf_dir):
    # Scan next to the source and join the narrow result, so that no text is shuffled.
    scanned = detect.scan(texts(spark, sf_dir, "documents", "doc_id")).select("doc_id", (F.size("matches") > 0).alias("hit"))
    return (
        scanned.join(table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("quality", "toxic")
        .agg(F.count("*").alias("docs"), F.count_if("hit").alias("with_findings"))
    )


_CUSTOM = Rules(
    rules=(*BUILTIN, Rule("CUSTOMER_ID", r"Customer#\d{9}"))
)


@query(
    "custom_rule_findings",
    f"with {sql.found('select c_custkey, c_name as text from customer', 'c_custkey', _CUSTOM)} select c_custkey, {SPANS} from found",
)
def custom_rule_findings(spark, sf_dir):
    rules = Rules().add("CUSTOMER_ID", r"Customer#\d{9}", spark)
    return detect.findings(table(spark, sf_dir, "customer"), ["c_custkey"], "c_name", rules)


_WITHOUT = Rules().disable("SECRET", "PHONE")


@query(
    "disabled_rule_counts",
    f"with {sql.found(DOCS, 'doc_id', _WITHOUT)} select type, {_COUNTS} from found group by type",
)
def disabled_rule_counts(spark, sf_dir):
    return detect.pii_counts(texts(spark, sf_dir, "documents", "doc_id"), rules=_WITHOUT)


# ── Redaction ────────────────────────────────────────────────────────────────────────────────────


def _redact_sql(source: str, key: str) -> str:
    return f"with {sql.found(source, key)}, {sql.tokens(key, key)}, {sql.redacted(key)} select {key}, redacted, items, types from red"


def _redact(df, key, text="text", rules=Rules()):
    return tokens.redact(df.select(key, text), text, rules).select(
        key, "redacted", "items", F.array_join("types", ",").alias("types")
    )


@query("redact_documents", _redact_sql(DOCS, "doc_id"))
def redact_documents(spark, sf_dir):
    return _redact(texts(spark, sf_dir, "documents", "doc_id"), "doc_id")


@query("redact_customers", _redact_sql(inputs.CUSTOMERS, "c_custkey"))
def redact_customers(spark, sf_dir):
    return _redact(customers(spark, sf_dir), "c_custkey", rules=DENSE)


@query("redact_pages", _redact_sql(PAGES, "page_id"))
def redact_pages(spark, sf_dir):
    return _redact(texts(spark, sf_dir, "pages", "page_id"), "page_id", "html")


def _map_sql(source: str, key: str) -> str:
    return f"with {sql.found(source, key)}, {sql.tokens(key, key)} select {key}, token, type, ordinal, value from tokens"


@query("token_map_documents", _map_sql(DOCS, "doc_id"))
def token_map_documents(spark, sf_dir):
    return tokens.token_map(texts(spark, sf_dir, "documents", "doc_id"), ["doc_id"])


@query("token_map_customers", _map_sql(inputs.CUSTOMERS, "c_custkey"))
def token_map_customers(spark, sf_dir):
    return tokens.token_map(customers(spark, sf_dir), ["c_custkey"], rules=DENSE)


@query(
    "token_stats_customers",
    f"""with {sql.found(inputs.CUSTOMERS, 'c_custkey')}, {sql.tokens('c_custkey', 'c_custkey')}
    select c_custkey, type, count(*) as unique_values from tokens group by c_custkey, type""",
)
def token_stats_customers(spark, sf_dir):
    return tokens.token_stats(tokens.token_map(customers(spark, sf_dir), ["c_custkey"], rules=DENSE), ["c_custkey"])


@query("restore_roundtrip_documents", "select doc_id, text as restored, false as ambiguous from documents")
def restore_roundtrip_documents(spark, sf_dir):
    redacted = tokens.redact(texts(spark, sf_dir, "documents", "doc_id"), with_map=True)
    return tokens.restore(redacted).select("doc_id", "restored", "ambiguous")


_REPLY = "concat('Re [EMAIL_1], [EMAIL_2] and [EMAIL_1]: [SSN_1] [PHONE_9] [', cast(c_custkey as string), '_1]')"


@query(
    "restore_replies",
    f"""with {sql.found(inputs.CUSTOMERS, 'c_custkey')}, {sql.tokens('c_custkey', 'c_custkey')},
    reply as (select c_custkey, {_REPLY} as reply from customer),
    e1 as (select c_custkey, value from tokens where token = '[EMAIL_1]'),
    e2 as (select c_custkey, value from tokens where token = '[EMAIL_2]'),
    s1 as (select c_custkey, value from tokens where token = '[SSN_1]')
    select r.c_custkey, replace(replace(replace(r.reply, '[EMAIL_1]', e1.value), '[EMAIL_2]', e2.value), '[SSN_1]', s1.value) as restored
    from reply r join e1 on e1.c_custkey = r.c_custkey join e2 on e2.c_custkey = r.c_custkey join s1 on s1.c_custkey = r.c_custkey""",
)
def restore_replies(spark, sf_dir):
    redacted = tokens.redact(customers(spark, sf_dir), rules=DENSE, with_map=True).withColumn("reply", F.expr(_REPLY))
    return tokens.restore(redacted, "reply").select("c_custkey", "restored")


# One numbering per source (documents) and per conversation.
@query(
    "redact_by_source",
    f"with {sql.found(DOCS, 'doc_id').replace('found as (select doc_id,', 'plain as (select doc_id,')}, "
    f"found as (select p.*, s.source from plain p join src s on s.doc_id = p.doc_id), "
    f"{sql.tokens('doc_id', 'source')}, {sql.redacted('doc_id')} select doc_id, redacted, items, types from red",
)
def redact_by_source(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    redacted, _ = tokens.redact_table(docs, ["doc_id"], ["source"])
    return redacted.select("doc_id", "redacted", "items", F.array_join("types", ",").alias("types"))


@query(
    "token_map_by_source",
    f"with {sql.found(DOCS, 'doc_id').replace('found as (select doc_id,', 'plain as (select doc_id,')}, "
    f"found as (select p.*, s.source from plain p join src s on s.doc_id = p.doc_id), "
    f"{sql.tokens('doc_id', 'source')} select source, token, type, ordinal, value from tokens",
)
def token_map_by_source(spark, sf_dir):
    found = detect.findings(texts(spark, sf_dir, "documents", "doc_id"), ["doc_id", "source"])
    return tokens.assign_tokens(found, ["source"], ["doc_id"])


@query("restore_roundtrip_by_source", "select doc_id, text as restored from documents")
def restore_roundtrip_by_source(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    redacted, numbered = tokens.redact_table(docs, ["doc_id"], ["source"])
    return tokens.restore_table(redacted, ["doc_id"], ["source"], numbered).select("doc_id", "restored")


_TURNS = """select conv_id * 1000 + turn as row_key, conv_id, turn, concat(text, ' mail c', cast(conv_id % 50 as string),
  '@example.com or t', cast(turn as string), '@example.com, ssn 123-45-', lpad(cast((conv_id * turn) % 10000 as string), 4, '0')) as text
  from conversations"""


@query(
    "redact_conversations",
    f"with {sql.found(_TURNS, 'row_key').replace('found as (select row_key,', 'plain as (select row_key,')}, "
    f"found as (select p.*, s.conv_id from plain p join src s on s.row_key = p.row_key), "
    f"{sql.tokens('row_key', 'conv_id')}, {sql.redacted('row_key')} "
    f"select s.conv_id, s.turn, r.redacted, r.items from red r join src s on s.row_key = r.row_key",
)
def redact_conversations(spark, sf_dir):
    turns = inputs._derived(spark, sf_dir, "conversations", _TURNS, "conv_id")
    redacted, _ = tokens.redact_table(turns, ["conv_id", "turn"], ["conv_id"])
    return redacted.select("conv_id", "turn", "redacted", "items")


# ── Policy ───────────────────────────────────────────────────────────────────────────────────────

POLICY = policy.Policy(inputs.BLOCKING)
_BLOCKED = """barred as (select {key}, type, min(start) as pos from {found} where type in ('SSN', 'CREDIT_CARD') group by {key}, type),
blocked as (select {key}, string_agg(type, ', ' order by pos) as blocked_types from barred group by {key})"""


def _policy_sql(source: str, key: str, found: str = "found") -> str:
    return f"{sql.found(source, key)}, {sql.tokens(key, key)}, {sql.redacted(key)}, {_BLOCKED.format(key=key, found=found)}"


@query(
    "policy_blocked_docs",
    f"""with {sql.found(DOCS, 'doc_id')}, {_BLOCKED.format(key='doc_id', found='found')}
    select b.doc_id, b.blocked_types, concat('Request blocked by DLP policy: contains ', b.blocked_types) as message, s.text
    from blocked b join src s on s.doc_id = b.doc_id""",
)
def policy_blocked_docs(spark, sf_dir):
    _, blocked = policy.quarantine_split(texts(spark, sf_dir, "documents", "doc_id"), POLICY)
    return blocked.select("doc_id", F.array_join("blocked_types", ", ").alias("blocked_types"), "message", "text")


@query(
    "policy_clean_docs",
    f"with {_policy_sql(DOCS, 'doc_id')} select doc_id, redacted, items from red where doc_id not in (select doc_id from blocked)",
)
def policy_clean_docs(spark, sf_dir):
    clean, _ = policy.quarantine_split(texts(spark, sf_dir, "documents", "doc_id"), POLICY)
    return clean.select("doc_id", "redacted", "items")


@query(
    "policy_before_overlap_removal",
    f"""with {sql.found(inputs.CUSTOMERS, 'c_custkey')}, kinds as (select c_custkey, type, min(start) as pos from raw
      where type in ('PASSWORD', 'EMAIL', 'SECRET') group by c_custkey, type)
    select c_custkey, string_agg(type, ', ' order by pos, type) as blocked_types from kinds group by c_custkey""",
)
def policy_before_overlap_removal(spark, sf_dir):
    strict = policy.Policy({"password": "block", "email": "block", "secret": "block"})
    rows = policy.classify(customers(spark, sf_dir), strict, rules=DENSE, before_overlap=True)
    return rows.filter("blocked").select("c_custkey", F.array_join("blocked_types", ", ").alias("blocked_types"))


@query(
    "policy_actions",
    f"""with {sql.found(DOCS, 'doc_id')} select type, case when type in ('SSN', 'CREDIT_CARD') then 'block' else 'redact' end as action,
    count(*) as findings from found group by type""",
)
def policy_actions(spark, sf_dir):
    counts = detect.pii_counts(texts(spark, sf_dir, "documents", "doc_id"))
    return counts.select("type", policy.policy_action(F.col("type"), POLICY).alias("action"), "findings")


@query(
    "policy_docs_by_action",
    f"""with {sql.found(DOCS, 'doc_id')}, {_BLOCKED.format(key='doc_id', found='found')}
    select case when b.doc_id is null then 'redact' else 'block' end as action, count(*) as docs
    from src s left join blocked b on b.doc_id = s.doc_id group by 1""",
)
def policy_docs_by_action(spark, sf_dir):
    scanned = detect.scan(texts(spark, sf_dir, "documents", "doc_id"))
    judged = policy.evaluate_policy(scanned, POLICY)
    action = F.when(F.col("policy.blocked"), policy.BLOCK).otherwise(policy.REDACT)
    return judged.groupBy(action.alias("action")).agg(F.count("*").alias("docs"))
