"""Log corpora derived from the tables at hand, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranks import following

#: Lines of five kinds of events and four lengths.
LOG_EVENTS = """
select event_id as line_id, case event_type
  when 'error' then concat('Request from user ', cast(user_id as string), ' failed with value ', cast(cast(value as decimal(12,2)) as string), ' props ', props)
  when 'click' then concat('User ', cast(user_id as string), ' clicked item, payload=', props)
  when 'view' then concat('Rendered page for session_', cast(user_id as string), ' in ', cast(cast(value as decimal(12,2)) as string), ' ms')
  else concat('Handled ', event_type, ' event id=', cast(event_id as string), ' ok') end as content
from events"""
#: Labelled and parsed templates of the same lines; some are parsed wrongly on purpose.
GT_PARSED = """
select event_id as line_id,
  case event_type when 'error' then 'Request from user <*> failed with value <*> props <*>'
    when 'click' then 'User <*> clicked item, payload=<*>'
    when 'view' then 'Rendered page for <*> in <*> ms'
    else concat('Handled ', event_type, ' event id=<*> ok') end as gt,
  case when event_type = 'error' then 'Request from user <*> failed with value <*> props <*>'
    when event_type = 'click' and user_id % 2 = 0 then 'User <*> clicked item, payload=<*>'
    when event_type = 'click' then 'User <*> clicked item, <*>'
    when event_type = 'view' then 'Rendered page for <*> in <*> <*>'
    when event_id % 10 = 0 then 'Handled <*> event id=<*> ok'
    else concat('Handled ', event_type, ' event id=<*> ok') end as parsed
from events"""
#: Every line with the next two of its kind of event.
LINE_PAIRS = f"""
select line_id, x, y, z from (select l.line_id, l.content as x, lead(l.content) over (partition by e.event_type order by l.line_id) as y, lead(l.content, 2) over (partition by e.event_type order by l.line_id) as z
  from ({LOG_EVENTS}) l join events e on e.event_id = l.line_id) p where z is not null"""
#: Lines whose values are wildcards, some next to each other.
RAW_LINES = f"select line_id, regexp_replace(replace(replace(content, 'id=', '#'), ' in ', '/1 '), '[0-9]', '<*>'{{flags}}) as template from ({LOG_EVENTS}) l"
#: Answers of a model, one for each event, of all forms that are read.
MODEL_ANSWERS = """
select event_id as id, case event_id % 5 when 0 then concat('LogTemplate[1]: `', event_type, ' {id}`', chr(10), 'LogTemplate[2]: `', props, '`')
  when 1 then concat('Sure!', chr(10), 'LogTemplate: `', event_type, '`', chr(10), 'no template') when 2 then concat('Log template[2]: ', props, chr(10), ' Log template: a=`1` ') when 3 then concat(' nothing here ', event_type, chr(10)) else '' end as answer
from events"""
#: Lines of a hundred kinds, whose words are letters; each kind is seen from three docks, in one length.
MERGING = """
select line_id, concat(kind, ' ', cast(line_id as string), ' ', reverse(kind), ' by dock', cast(line_id % 10 % 3 as string), ' ', kind, 'x') as content, kind, line_id % 10 % 3 as dock from (
  select l_orderkey * 10 + l_linenumber as line_id, concat(chr(97 + cast(min(l_partkey) % 10 as int)), chr(97 + cast(floor((min(l_partkey) % 100) / 10) as int)), 'kind') as kind from lineitem group by 1) k"""
#: Neighbouring lines of an order as templates, in pairs: values of all forms that merge, or that don't.
TEMPLATE_PAIRS = """
select line_id, x, y from (select line_id, x, lead(x) over (partition by p, floor(line_id / 400) order by line_id) as y from (
  select line_id, p, case p when 0 then concat('open /bin/', cast(q as string), '/p', cast(p as string), ' for s', cast(s as string), ' now') when 1 then concat('part ', flag, ' of ', mixed, ' at host', cast(s as string), ' moved by <*> to <*> in <*> steps')
    when 2 then concat('call f', cast(s % 3 as string), '() ok') else concat('state ', word, ' value ', cast(q as string), '.', cast(s as string)) end as x from (
    select l_orderkey * 10 + l_linenumber as line_id, cast(min(l_orderkey) % 4 as bigint) as p, cast(min(l_quantity) as bigint) % 30 as q, min(l_suppkey) % 12 as s, case when min(l_suppkey) % 2 = 0 then 'AF' else 'ARF' end as flag,
      case when min(l_partkey) % 3 = 0 then 'k_1' when min(l_partkey) % 3 = 1 then 'k-2' else 'k-33' end as mixed, case when min(l_suppkey) % 3 = 0 then 'open' else 'shut' end as word from lineitem group by 1) a) b) c where y is not null"""
#: Templates whose wildcards take from no to three words.
TREE_TEMPLATES = (
    "Handled <*> ok", "Handled signup event <*>", "Request from user <*> failed <*>", "Request from <*> with value <*> props k 1", "User <*> clicked item <*>", "User <*> clicked <*> item payload=k <*>", "<*> clicked <*> 7",
    "Rendered page for <*> in <*> seconds", "Rendered page <*> in 1 <*> ms", "Rendered <*> page for <*> in 2 <*> ms", "Rendered page <*> for <*> 5 ms", "Dropped <*>", "Handled purchase event",
)
#: Templates of the lines above, some of them overlapping, one that covers none.
TEMPLATES = (
    'User <*> clicked item, payload={"k": <*>', "User <*> clicked item, <*> <*>", "Rendered page for <*> in <*> ms", "Rendered page <*> <*> in <*> ms",
    "Handled <*> event id=<*> ok", "Handled signup event id=<*> ok", "Request <*> user <*> failed with value <*> props <*> <*>", "Dropped <*> of <*>",
)
TEMPLATE_VALUES = ", ".join(f"('{t}')" for t in TEMPLATES)
#: Templates of customers, under ids, that the older rules make a few.
CORRECTABLE = """
select concat('E', cast(c_custkey as string)) as event_id, case c_custkey % 4 when 0 then concat('path /a/', cast(c_custkey as string), ' ok') when 1 then concat('user ', case when c_custkey % 8 = 1 then 'root' else 'admin' end, ' in')
  when 2 then concat('count ', cast(c_custkey as string), ' of 20') else concat('nation ', chr(97 + cast(c_nationkey as int)), ' seen') end as template from customer"""


def view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """``sql`` over one table of a folder."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", LOG_EVENTS)


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `LINE_PAIRS`, without gathering a kind of event in one task."""
    kinds = view(spark, sf_dir, "events", f"select l.line_id, e.event_type as kind, l.content as x from ({LOG_EVENTS}) l join events e on e.event_id = l.line_id")
    return following(kinds, "kind", "line_id", "x", ("y", "z")).where("z is not null").select("line_id", "x", "y", "z")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", RAW_LINES.format(flags=""))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", MODEL_ANSWERS)


def gt_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", GT_PARSED)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, content): lines of documents; the id holds the document's id and the line's number."""
    return view(spark, sf_dir, "documents", "select doc_id * 100000 + ln as line_id, line as content from documents lateral view posexplode(split(text, '\\n')) t as ln, line")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEMPLATES], "template string")


def template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", TEMPLATE_PAIRS)
