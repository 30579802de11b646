"""Records from labelled spans: merge policies by field, feature rows for the models, partial dates, metadata JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import text as T

#: How spans of one label become a field (policy, separator), by model.
POLICIES = {
    "header": {
        "title": ("first", ""), "abstract": ("first", ""), "page": ("first", ""), "publisher": ("first", ""), "journal": ("first", ""), "date": ("longest", ""), "reference": ("last", ""),
        "author": ("concat", "\t"), "email": ("concat", "\t"), "meeting": ("concat", ", "), "editor": ("concat", "\n"), "affiliation": ("concat", " ; "), "copyright": ("concat", " "),
        "address": ("concat", " "), "submission": ("concat", " "), "funding": ("concat", " \n "), "keyword": ("concat", " \n "), "availability": ("concat", " \n "), "phone": ("concat", ""), "web": ("concat", ""),
    },
    "citation": {
        "title": ("longest", ""), "booktitle": ("longest", ""), "series": ("longest", ""), "journal": ("longest", ""), "author": ("concat", " ; "), "collaboration": ("concat", " ; "),
        "institution": ("concat", " ; "), "location": ("concat", "; "), "date": ("concat", ". "), "volume": ("first", ""), "issue": ("first", ""), "tech": ("last", ""), "pages": ("last", ""),
        "publisher": ("last", ""), "editor": ("last", ""), "web": ("last", ""),
    },
}


def merged_fields(spans: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """(keys, label, pos, text) -> one row for each key with a column for each field of the model; labels without a policy are left out."""
    policies = POLICIES[model]
    columns = []
    for name, (policy, separator) in policies.items():
        mine = F.col("label") == name
        ordered = F.array_sort(F.collect_list(F.when(mine, F.struct("pos", "text"))))
        texts = F.transform(ordered, lambda s: s["text"])
        if policy == "concat":
            value = F.when(F.size(texts) > 0, F.array_join(texts, separator))
        elif policy == "longest":  # the earlier one on ties
            value = F.max_by(F.when(mine, F.col("text")), F.when(mine, F.struct(F.length("text").alias("n"), (-F.col("pos")).alias("p"), "text")))
        else:
            value = (F.min_by if policy == "first" else F.max_by)(F.when(mine, F.col("text")), F.when(mine, F.struct("pos", "text")))
        columns.append(value.alias(name))
    return spans.groupBy(*keys).agg(*columns)


def feature_rows(tokens: DataFrame, keys: Sequence[str], order: str, token: str, model: str = "date") -> DataFrame:
    """Feature rows of the token models: token, lower case, beginnings and ends, line status, case, digits and so on.

    White space isn't a token of its own here: it only sets the line status of its neighbours.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    t = tokens.withColumn("_prev", F.lag(token).over(w)).withColumn("_next", F.lead(token).over(w))
    t = t.where(F.trim(F.col(token), F.lit(" \t\n\r\f")) != "")
    solid = Window.partitionBy(*keys).orderBy(order)
    c = F.col(token)
    first = F.coalesce(F.col("_prev") == "\n", F.lit(True)) | (F.row_number().over(solid) == 1)
    last = F.coalesce(F.col("_next") == "\n", F.lit(True))
    tests = T.predicates(c)
    digits = F.when(tests["all_digit"], "ALLDIGIT").when(tests["has_digit"], "CONTAINSDIGITS").otherwise("NODIGIT")
    caps = F.when(tests["all_digit"], "NOCAPS").when(tests["all_capital"], "ALLCAP").when(tests["first_capital"], "INITCAP").otherwise("NOCAPS")
    columns = [c, F.lower(c), *(F.left(c, F.lit(k)) for k in (1, 2, 3, 4)), *(F.right(c, F.lit(k)) for k in (1, 2, 3, 4))]
    columns += [F.when(first, "LINESTART").when(last, "LINEEND").otherwise("LINEIN"), caps, digits, F.when(tests["single_char"], "1").otherwise("0")]
    if model == "date":
        from codexa.functions.identifiers import month_number

        columns += [F.when(tests["year"], "1").otherwise("0"), F.when(month_number(c).isNotNull() & c.rlike(r"^\p{L}"), "1").otherwise("0")]
    columns.append(T.punctuation_type(c))
    return t.select(*keys, order, F.array(*columns).alias("cols"))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """As much of an ISO date as is known."""
    return F.when(year.isNull(), None).when(month.isNull(), F.format_string("%04d", year)).when(day.isNull(), F.format_string("%04d-%02d", year, month)).otherwise(F.format_string("%04d-%02d-%02d", year, month, day))


def date_order(year: Column, month: Column, day: Column) -> Column:
    """A sort key: earlier first, and of equal dates the more specific first."""
    far = F.lit(99)
    return F.struct(F.coalesce(year, F.lit(9999)).alias("y"), F.coalesce(month, far).alias("m"), F.coalesce(day, far).alias("d"))


WORK = "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,volume:string,issue:string,page:string,issued:struct<`date-parts`:array<array<int>>>>"


def works(responses: DataFrame, column: str = "json") -> DataFrame:
    """Metadata responses (a single message or a list of items) as one row for each work."""
    both = F.from_json(column, f"struct<message:struct<items:array<{WORK}>,{WORK[7:-1]}>>")
    single = F.from_json(column, f"struct<message:{WORK}>")["message"]
    items = F.coalesce(both["message"]["items"], F.when(single["DOI"].isNotNull(), F.array(single)))
    w = responses.select(F.explode(items).alias("w"))
    first = lambda c: F.get(c, F.lit(0))
    return w.select(
        F.lower("w.DOI").alias("doi"), first(F.col("w.title")).alias("title"), F.transform("w.author", lambda a: a["family"]).alias("surnames"), first(F.col("w.container-title")).alias("container"),
        F.col("w.volume").alias("volume"), F.col("w.issue").alias("issue"), F.regexp_extract("w.page", r"^(\w+)", 1).alias("first_page"), first(first(F.col("w.issued.date-parts"))).alias("year"),
    )


def openurl(fields: dict[str, Column]) -> Column:
    """A query string of the fields that have a value."""
    return F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in fields.items()))), "&")


def section_number(head: Column) -> Column:
    """struct(number, title) of heads like '2.1 Methods' or 'IV. Results'; an empty number if there is none."""
    pattern = r"^\s*((?:\d+(?:\s*\.\s*\d+)*|[IVX]+)\.?)\s+(.*)$"
    number = F.regexp_replace(F.regexp_extract(head, pattern, 1), r"\s|\.$", "")
    return F.struct(number.alias("number"), F.when(number == "", F.trim(head)).otherwise(F.regexp_extract(head, pattern, 2)).alias("title"))


def coordinates(page: Column, boxes: Column) -> Column:
    """Boxes as 'page,x,y,w,h;…' with two decimals."""
    return F.array_join(F.transform(boxes, lambda b: F.format_string("%d,%.2f,%.2f,%.2f,%.2f", page, b["x"], b["y"], b["w"], b["h"])), ";")
