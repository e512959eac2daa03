"""Chat formatting by schema fingerprints: a record's nested field paths select the mapping that turns it into turns.

Records are typed (a struct, whose schema is fingerprinted once for the table) or JSON texts of mixed layouts (fingerprinted one by
one). The paths of all nested fields to any depth, not their scalar types, are hashed; MAPPINGS tells, for each known set of paths,
where roles and texts stand. The template then marks turns and escapes its control strings inside texts reversibly, and the
loss mask is a list of spans over the formatted text, in code points and in bytes of UTF-8 (which are cut without a scan).

Unparsable records and those of an unknown layout get null turns, so none is dropped. Null texts and roles are empty. Repeated records
each keep their row; an empty table gives an empty one. Columns named as an added one are renamed with _0 behind. Records are handled
on their own, one row each. Typed records are of any length, as no text of theirs is parsed; a JSON record of more than PARSED bytes
that doesn't parse is an error.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import make_way, text_of

#: Layouts by nested field paths. list: (array, role field, text field), roles: what that layout calls other roles; fields: (role,
#: field) in order.
MAPPINGS = {
    "messages[].content|messages[].role": {"list": ("messages", "role", "content")},
    "messages[].role|messages[].text|messages[].turn": {"list": ("messages", "role", "text")},
    "conversations[].from|conversations[].value": {"list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    "completion|prompt": {"fields": [("user", "prompt"), ("assistant", "completion")]},
    "prompt|response|system": {"fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "input|instruction|output": {"fields": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    "instruction|output": {"fields": [("user", "instruction"), ("assistant", "output")]},
}
#: Bytes of a record up to which no limit of the parser applies (20 million characters a string, 128 MB a variant).
PARSED = 20_000_000
TURNS = "array<struct<role:string,text:string>>"
#: A control string's opening, backslashes that earlier escapes left, and its rest.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def parsed(record: Column) -> Column:
    """The record as a variant, null when it isn't JSON. A long one that doesn't parse may be JSON beyond the parser's limits: an error."""
    v = F.try_parse_json(record)
    lost = F.raise_error(F.concat(F.lit("a record does not parse, for its form or its size: bytes "), F.octet_length(record).cast("string")))
    return F.when(v.isNull() & (F.octet_length(record) > PARSED), lost.cast("variant")).otherwise(v)


def paths(record: Column) -> Column:
    """Sorted paths of a JSON record's fields, joined by |: object.field, array[].field, nested to any depth. Scalars alone have none;
    an empty object or array counts as a scalar."""
    # The schema's text is read token by token: a name sets the path, <> open and close a level, anything else ends a path.
    tokens = F.regexp_extract_all(F.schema_of_variant(parsed(record)), F.lit(r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<>|OBJECT<|ARRAY<|>|\w+(?:\([^)]*\))?"), F.lit(0))
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        name = F.replace(F.regexp_replace(t, "^`|`?: $", ""), F.lit("``"), F.lit("`"))
        deeper = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        named, closed = t.endswith(": "), t == ">"
        inner, array = t == "OBJECT<", t == "ARRAY<"
        return F.struct(
            F.when(inner, F.concat(s["open"], F.array(deeper))).when(array, F.concat(s["open"], F.array(s["at"]))).when(closed, F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when(named, F.concat(F.element_at(s["open"], -1), name)).when(array, F.concat(s["at"], F.lit("[]"))).otherwise(s["at"]).alias("at"),
            F.when(named | closed | inner | array | (s["at"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["at"]))).alias("out"),
        )

    return F.array_join(F.array_sort(F.aggregate(tokens, start, step, lambda s: s["out"])), "|")


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The same paths of a typed record's schema, unsorted."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at] if at else []


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def _role(role: Column, other: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, meant in other.items():
        role = F.when(role == name, meant).otherwise(role)
    return role


def turns(record: Column, schema: Column, mappings=MAPPINGS) -> Column:
    """schema: the record's fingerprint. Array of (role, text), or null for an unknown layout."""
    v = F.try_parse_json(record)
    out = F.lit(None).cast(TURNS)
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    for known, m in mappings.items():
        if "list" in m:
            array, role, text = m["list"]
            one = partial(lambda r, x, known, t: turn(_role(t[r], known), t[x]), role, text, m.get("roles", {}))
            got = F.transform(F.try_variant_get(v, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>"), lambda t: one(t))  # noqa: B023
        else:
            got = F.array(*[turn(F.lit(role), F.try_variant_get(v, f"$.{field}", "string")) for role, field in m["fields"]])
        out = F.when(schema == F.xxhash64(F.lit(known)), got).otherwise(out)
    return out


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def formatted(turns: Column) -> Column:
    """<s>role[INST]text[/INST]</s> for each turn, with escaped roles and texts."""
    each = F.transform(turns, lambda t: F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]"), escape(t["text"]), F.lit("[/INST]</s>")))
    return F.array_join(each, "")


def _with(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_back(text: Column) -> Column:
    """The turns of a formatted text, with the place of each text in it: start and length in code points, byte_start and byte_length
    in bytes of UTF-8, from 0."""
    part = lambda p: F.struct(F.substring_index(p, "[INST]", 1).alias("role"), F.regexp_replace(F.substring(p, F.locate("[INST]", p) + 6, F.length(p)), r"\[/INST\]</s>$", "").alias("text"))
    raw = F.transform(F.filter(F.split(text, "<s>"), lambda p: F.length(p) > 0), part)
    piece = "array<struct<role:string,text:string,start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>>"
    zero, none = F.lit(0).cast("long"), F.array().cast(piece)

    def step(s: Column, t: Column) -> Column:
        size, wide = F.length(t["text"]).cast("long"), F.octet_length(t["text"]).cast("long")
        start, byte = s["at"] + 9 + F.length(t["role"]), s["byte"] + 9 + F.octet_length(t["role"])
        one = F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"), start.alias("start"), size.alias("length"), byte.alias("byte_start"), wide.alias("byte_length"))
        return F.struct((start + size + 11).alias("at"), (byte + wide + 11).alias("byte"), F.concat(s["out"], F.array(one)).alias("out"))

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block["out"], lambda t: t.withField("start", t["start"] + by["at"]).withField("byte_start", t["byte_start"] + by["byte"]))

    def placed(raw: Column) -> Column:
        # Places are running sums. An array that grows turn by turn is copied at each, so a long one goes by blocks of its length's root.
        count = F.size(raw)
        width = F.greatest(F.ceil(F.sqrt(count)).cast("int"), F.lit(1))
        starts = F.when(count > 0, F.sequence(F.lit(1), count, width)).otherwise(F.array().cast("array<int>"))
        place = lambda at, byte, out: F.struct(at.alias("at"), byte.alias("byte"), out.alias("out"))
        local = F.transform(starts, lambda a: F.aggregate(F.slice(raw, a, width), place(zero, zero, none), step))
        so_far = lambda s: F.array(F.struct(s["at"].alias("at"), s["byte"].alias("byte")))
        begin = place(zero, zero, F.array().cast("array<struct<at:bigint,byte:bigint>>"))
        before = lambda blocks: F.aggregate(blocks, begin, lambda s, b: place(s["at"] + b["at"], s["byte"] + b["byte"], F.concat(s["out"], so_far(s))), lambda s: s["out"])
        return _with(local, lambda blocks: F.flatten(F.zip_with(blocks, before(blocks), shifted)))

    return F.when(text.isNotNull(), _with(raw, placed))


def under_mask(text: Column, spans: Column) -> Column:
    """What the loss mask covers in a formatted text, unescaped and in order. Spans are cut out of its bytes by place: no cut scans what
    stands before it, and a span that is no whole text of code points is an error."""
    raw = F.encode(text, "UTF-8")

    def cut(raw: Column, s: Column) -> Column:
        part = F.decode(F.substring(raw, s["byte_start"].cast("int") + 1, s["byte_length"].cast("int")), "UTF-8")
        wrong = F.raise_error(F.lit("a span's bytes are not its code points"))
        return F.when(F.length(part) == s["length"], unescape(part)).otherwise(wrong)

    return _with(raw, lambda raw: F.array_join(F.transform(spans, lambda s: cut(raw, s)), ""))


def typed_turns(record: Column, kind: T.StructType, mappings=MAPPINGS) -> Column:
    """As `turns`, of a typed record: its schema's fingerprint selects the mapping, and no text passes through a parser."""
    m = mappings.get("|".join(sorted(schema_paths(kind))))
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    if m is None:
        return F.lit(None).cast(TURNS)
    if "list" in m:
        array, role, text = m["list"]
        return F.transform(record[array], lambda t: turn(_role(t[role], m.get("roles", {})), t[text]))
    return F.when(record.isNotNull(), F.array(*[turn(F.lit(role), record[field]) for role, field in m["fields"]]))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """`records` with schema_hash, formatted and loss_spans: start and length of each assistant text in code points, byte_start and
    byte_length in bytes. The record column is a struct or a JSON text."""
    made = make_way(records.withColumnRenamed(record, "__record"), "schema_hash", "formatted", "loss_spans").withColumnRenamed("__record", record)
    kind = made.schema[record].dataType
    if isinstance(kind, T.StructType):
        known = F.xxhash64(F.lit("|".join(sorted(schema_paths(kind)))))
        out = made.withColumns({"schema_hash": known, "formatted": formatted(typed_turns(F.col(record), kind))})
    else:
        out = made.withColumn("schema_hash", fingerprint(F.col(record)))
        out = out.withColumn("formatted", formatted(turns(F.col(record), F.col("schema_hash"))))
    spans = F.transform(F.filter(read_back(F.col("formatted")), lambda t: t["role"] == "assistant"), lambda t: F.struct(*[t[n].alias(n) for n in ("start", "length", "byte_start", "byte_length")]))
    return out.withColumn("loss_spans", spans)


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): a conversation's rows as one typed record, messages by turn. A conversation is one training example, so its rows
    meet in one task by nature; rows of different conversations never do by key. A row without conv_id is a conversation by itself."""
    conv = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text")).alias("m"))
    record = lambda messages: F.struct(messages.alias("messages")).alias("record")
    alone = conv.where(F.col("conv_id").isNull()).select("conv_id", record(F.array("m")))
    return conv.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(record(F.sort_array(F.collect_list("m")))).unionByName(alone)


def digest(records: DataFrame, mask: Column | None = None) -> DataFrame:
    """The contract's columns of (conv_id, record) rows, read back from the formatted text: turns through the template, loss through the
    mask (loss_spans unless another is given)."""
    done = format_chats(records.select("conv_id", "record")).select("conv_id", "formatted", (F.col("loss_spans") if mask is None else mask).alias("loss_spans"))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    done = done.withColumns({"back": read_back(F.col("formatted")), "lost": under_mask(F.col("formatted"), F.col("loss_spans"))})
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", turn), ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, '{own}' text from values (0, 'user'), (1, 'assistant') v(t, r)")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return digest(as_records(rows))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, row_number() over () rid from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 0 union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 0
), e as (
  select *, 3 + 6 + 11 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) chars from c
)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars
from e group by conv_id, case when conv_id is null then rid end
"""
