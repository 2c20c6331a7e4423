"""How Presto's functions and types are written for Spark: by another name, or by a template over the arguments' text."""

from __future__ import annotations

#: Presto name -> Spark name, where only the name differs.
RENAMED = {
    "approx_distinct": "approx_count_distinct", "arbitrary": "any_value", "all_match": "forall", "any_match": "exists", "bitwise_and_agg": "bit_and", "bitwise_or_agg": "bit_or",
    "bitwise_xor_agg": "bit_xor", "bitwise_left_shift": "shiftleft", "bitwise_right_shift": "shiftrightunsigned", "bitwise_arithmetic_shift_right": "shiftright", "contains": "array_contains",
    "codepoint": "ascii", "element_at": "try_element_at", "ends_with": "endswith", "from_base64": "unbase64", "from_hex": "unhex", "from_iso8601_date": "to_date", "is_nan": "isnan",
    "json_extract": "get_json_object", "json_extract_scalar": "get_json_object", "last_day_of_month": "last_day", "levenshtein_distance": "levenshtein", 
    "numeric_histogram": "histogram_numeric", "random": "rand", "reduce": "aggregate", "regexp_position": "regexp_instr", "regexp_split": "split", "remove_nulls": "array_compact", "repeat": "array_repeat",
    "set_agg": "collect_set", "starts_with": "startswith", "strpos": "instr", "to_base64": "base64", "to_hex": "hex", "zip": "arrays_zip",
}

#: Fields of EXTRACT, which are also functions of one argument.
FIELDS = {
    "year": "year({0})", "quarter": "quarter({0})", "month": "month({0})", "week": "weekofyear({0})", "week_of_year": "weekofyear({0})", "day": "day({0})", "day_of_month": "day({0})",
    "day_of_week": "(weekday({0}) + 1)", "dow": "(weekday({0}) + 1)", "day_of_year": "dayofyear({0})", "doy": "dayofyear({0})", "year_of_week": "extract(yearofweek from {0})",
    "yow": "extract(yearofweek from {0})", "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})", "millisecond": "cast(extract(microseconds from {0}) div 1000 % 1000 as bigint)",
    "timezone_hour": "cast(substr(date_format({0}, 'xxx'), 1, 3) as int)", "timezone_minute": "cast(concat(substr(date_format({0}, 'xxx'), 1, 1), substr(date_format({0}, 'xxx'), 5, 2)) as int)",
}

#: Fixed values: (name, number of arguments) -> text; None stands for any number. {0} is the first argument, {all} the list.
TEMPLATES = {
    ("strpos", 3): "instr({0}, {1})", ("regexp_extract", 2): "regexp_substr({0}, {1})", ("regexp_extract", 3): "if(regexp_like({0}, {1}), regexp_extract({0}, {1}, {2}), null)",
    ("regexp_extract_all", 2): "regexp_extract_all({0}, {1}, 0)", ("regexp_replace", 2): "regexp_replace({0}, {1}, '')", ("chr", 1): "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')",
    ("hamming_distance", 2): "size(filter(zip_with(split({0}, ''), split({1}, ''), (p, q) -> p <> q), d -> d))", ("to_utf8", 1): "encode({0}, 'UTF-8')", ("from_utf8", 1): "decode({0}, 'UTF-8')",
    ("is_nan", 1): "if({0} IS NULL, NULL, isnan({0}))", ("truncate", 1): "(case when {0} < 0 then -floor(-{0}) else floor({0}) end * 1e0)", ("log", 2): "log({0}, {1})", ("mod", 2): "({0} % {1})", ("is_finite", 1): "(not isnan({0}) and abs({0}) <> double('infinity'))",
    ("is_infinite", 1): "(abs({0}) = double('infinity'))", ("nan", 0): "double('nan')", ("infinity", 0): "double('infinity')", ("bitwise_and", 2): "({0} & {1})", ("bitwise_or", 2): "({0} | {1})",
    ("bitwise_xor", 2): "({0} ^ {1})", ("bitwise_not", 1): "(~{0})", ("bit_count", 2): "bit_count({0})", ("to_base", 2): "lower(conv(cast({0} as string), 10, {1}))", ("from_base", 2): "cast(conv({0}, {1}, 10) as bigint)",
    ("date_add", 3): "timestampadd({unit0}, {1}, {2})", ("date_diff", 3): "timestampdiff({unit0}, {1}, {2})", ("from_unixtime", 1): "timestamp_micros(cast(cast({0} as double) * 1000000 as bigint))",
    ("to_unixtime", 1): "(unix_micros(cast({0} as timestamp)) / 1e6)", ("from_iso8601_timestamp", 1): "cast({0} as timestamp)", ("to_iso8601", 1): "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\")",
    ("at_timezone", 2): "convert_timezone(current_timezone(), {1}, cast({0} as timestamp_ntz))", ("none_match", 2): "(not exists({0}, {1}))", ("map", 0): "map()", ("map", 2): "map_from_arrays({0}, {1})",
    ("array_average", 1): "aggregate({0}, cast(named_struct('s', 0e0, 'n', 0) as struct<s: double, n: int>), (a, x) -> named_struct('s', a.s + coalesce(x, 0e0), 'n', a.n + if(x is null, 0, 1)), a -> if(a.n = 0, null, a.s / a.n))",
    ("trim_array", 2): "slice({0}, 1, size({0}) - {1})", ("ngrams", 2): "transform(sequence(1, greatest(1, size({0}) - {1} + 1)), i -> slice({0}, cast(i as int), {1}))", ("array_sum", 1): "aggregate({0}, 0e0, (a, x) -> a + coalesce(x, 0))",
    ("combinations", 2): "filter(transform(sequence(0, shiftleft(1, size({0})) - 1), m -> filter({0}, (x, i) -> (shiftright(m, i) & 1) = 1)), c -> size(c) = {1})", ("array_frequency", 1): "map_from_entries(transform(array_distinct(array_compact({0})), v -> struct(v, size(filter({0}, y -> y = v)))))",
    ("map_agg", 2): "map_from_entries(collect_list(struct({0}, {1})))", ("map_union", 1): "map_from_entries(array_distinct(flatten(collect_list(map_entries({0})))))",
    ("multimap_agg", 2): "element_at(transform(array(collect_list(struct({0} as k, {1} as v))), l -> map_from_entries(transform(array_distinct(transform(l, e -> e.k)), k -> struct(k, transform(filter(l, e -> e.k = k), e -> e.v))))), 1)",
    ("histogram", 1): "element_at(transform(array(collect_list({0})), l -> map_from_entries(transform(array_distinct(l), v -> struct(v, cast(size(filter(l, y -> y = v)) as bigint))))), 1)",
    ("json_parse", 1): "{0}", ("json_format", 1): "{0}", ("json_size", 2): "coalesce(size(json_object_keys(get_json_object({0}, {1}))), json_array_length(get_json_object({0}, {1})), 0)",
    ("json_array_contains", 2): "array_contains(from_json({0}, 'array<string>'), cast({1} as string))", ("md5", 1): "unhex(md5({0}))", ("sha1", 1): "unhex(sha1({0}))", ("sha256", 1): "unhex(sha2({0}, 256))", ("sha512", 1): "unhex(sha2({0}, 512))",
    ("url_extract_host", 1): "parse_url({0}, 'HOST')", ("url_extract_path", 1): "parse_url({0}, 'PATH')", ("url_extract_protocol", 1): "parse_url({0}, 'PROTOCOL')", ("url_extract_query", 1): "parse_url({0}, 'QUERY')",
    ("url_extract_fragment", 1): "parse_url({0}, 'REF')", ("url_extract_parameter", 2): "parse_url({0}, 'QUERY', {1})", ("url_extract_port", 1): "cast(nullif(regexp_extract({0}, '^[a-z]+://[^/:?#]*:([0-9]+)', 1), '') as bigint)",
    ("geometric_mean", 1): "exp(avg(ln({0})))", ("entropy", 1): "((ln(sum({0})) - sum(if({0} = 0, 0e0, {0} * ln({0}))) / sum({0})) / ln(2e0))", ("max", 2): "slice(sort_array(collect_list({0}), false), 1, {1})", ("min", 2): "slice(sort_array(collect_list({0})), 1, {1})",
    ("reduce_agg", 4): "aggregate(collect_list({0}), {1}, {2})", ("checksum", 1): "sum(cast(xxhash64({0}) as decimal(38, 0)))", ("approx_most_frequent", 3): "map_from_entries(transform(approx_top_k({1}, cast({0} as int), cast({2} as int)), e -> struct(e.item, e.count)))",
    ("array_agg", 1): "transform(collect_list(struct({0} as x)), s -> s.x)", ("if", 2): "if({0}, {1}, null)",
    ("greatest", None): "if({nulls}, null, greatest({all}))", ("least", None): "if({nulls}, null, least({all}))", ("row", None): "struct({all})",
}

#: Presto types and their names in Spark, and letters of Presto's date formats.
TYPES = {"varchar": "string", "char": "string", "double": "double", "real": "float", "varbinary": "binary", "integer": "int", "timestamp": "timestamp_ntz", "json": "string"}
DATE_FORMAT = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a",
    "a": "EEE", "W": "EEEE", "j": "DDD", "T": "HH:mm:ss", "%": "%",
}


def date_format(text: str) -> str:
    """A format such as %Y-%m-%d as Spark's pattern; other letters are quoted."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            out, i = out + DATE_FORMAT.get(text[i + 1], text[i + 1]), i + 2
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out
