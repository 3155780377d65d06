"""Takeoff lines, prices and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import vocab
from wayfind.functions import text
from wayfind.operators.rules import JOB

_SIZE = r"(\d+(?:\.\d+)?)\s*[×xX]\s*(\d+(?:\.\d+)?)"


def rounded(x: Column) -> Column:
    """To cents, half up."""
    return F.floor(x * 100 + 0.5) / 100


def dimensions(sign_type: Column) -> Column:
    """The size that a sign of this type has by default, as text."""
    return F.when(sign_type.isin(*vocab.LARGE_SIGNS), "18 × 24").otherwise("6 × 8")


def unit_price(sign_type: Column, size: Column) -> Column:
    """List price: a flat one, else rate by area with a least price; a size in the text goes before the list's."""
    slug = text.sign_type_slug(sign_type)
    of = lambda i: text.by_type(slug, {k: F.lit(float(v[i])) for k, v in vocab.LIST_PRICES.items()}, float(vocab.OTHER_PRICE[i]))
    side = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(size, F.lit("")), _SIZE, i), F.lit("")).cast("double"), of(i + 1))
    flat = text.by_type(slug, {k: F.lit(v) for k, v in vocab.FLAT_PRICES.items()}, None)
    return rounded(F.coalesce(flat, F.greatest(of(4), (of(0) + of(1)) * side(1) * side(2))))


def takeoff_lines(signs: DataFrame) -> DataFrame:
    """Live lines with shown level, sort keys, unit and extended price. A global order is the writer's choice."""
    return _lines(signs)


def _lines(signs: DataFrame, *more: str) -> DataFrame:
    size = dimensions(F.col("sign_type"))
    out = signs.filter(~F.col("is_deleted")).select(*JOB, "seq", *more, "sign_type", F.coalesce("qty", F.lit(1)).alias("qty"), text.format_level(F.col("floor_label")).alias("level"), text.floor_sort_key(F.col("floor_label")).alias("floor_key"), text.wing_sort_key(F.col("room_number")).alias("room_key"), unit_price(F.col("sign_type"), size).alias("unit_price"))
    return out.withColumn("extended", rounded(F.col("unit_price") * F.col("qty")))


def room_lines(signs: DataFrame, rooms: DataFrame) -> DataFrame:
    """Live lines with the number, name and level of their room; the sign's own floor where the room has none."""
    own = rooms.select(*JOB, F.col("seq").alias("room_seq"), "room_number", "room_name", F.nullif("level", F.lit("")).alias("_level"))
    joined = signs.select(*(c for c in signs.columns if c not in ("room_number", "room_name"))).join(own, [*JOB, "room_seq"], "left")
    named = joined.withColumns({"room_number": F.coalesce("room_number", F.lit("")), "room_name": F.coalesce("room_name", F.lit("")), "floor_label": F.coalesce("_level", "floor_label")})
    return _lines(named, "room_number", "room_name")


def floor_totals(lines: DataFrame) -> DataFrame:
    """Per job: subtotal of each floor and the total (level null), from sums by job and floor."""
    by_floor = lines.groupBy(*JOB, "level").agg(F.sum("qty").alias("qty"), F.sum("extended").alias("extended"))
    total = by_floor.groupBy(*JOB).agg(F.sum("qty").alias("qty"), F.sum("extended").alias("extended")).withColumn("level", F.lit(None).cast("string"))
    return by_floor.unionByName(total).withColumn("extended", F.round("extended", 2))


def type_summary(signs: DataFrame) -> DataFrame:
    """Per job and type: quantity, size of the first line, braille."""
    live = signs.filter(~F.col("is_deleted"))
    out = live.groupBy(*JOB, "sign_type").agg(F.sum("qty").alias("qty"), F.min_by(dimensions(F.col("sign_type")), "seq").alias("size"))
    return out.withColumn("ada", F.col("sign_type").isin(*vocab.ADA_REQUIRED))


def pricing_tab(signs: DataFrame) -> DataFrame:
    """Per job and type: unit and extended price, installation."""
    out = type_summary(signs).withColumn("unit_price", unit_price(F.col("sign_type"), F.col("size")))
    return out.withColumn("extended", F.round(F.col("unit_price") * F.col("qty"), 2)).withColumn("installation", F.round(F.col("qty") * install_price(F.col("sign_type")), 2))


def install_price(sign_type: Column, own_default: Column | None = None, own: Column | None = None) -> Column:
    """Installation of one sign: that of its type in the tenant's list (a map), or in the built-in one where the tenant
    has none; else the tenant's default, or the built-in one."""
    built_in = text.by_type(sign_type, {k: F.lit(v) for k, v in vocab.INSTALL_OVERRIDES.items()}, None)
    default = F.lit(vocab.INSTALL_PRICE) if own_default is None else F.coalesce(own_default, F.lit(vocab.INSTALL_PRICE))
    listed = built_in if own is None else F.when(own.isNull(), built_in).otherwise(F.try_element_at(own, sign_type))
    return F.coalesce(listed, default)


def tenant_rates(materials: DataFrame, finishings: DataFrame, defaults: DataFrame) -> DataFrame:
    """(tenant_id, slug, rate, width, height, least, material, finishing): a tenant's own prices by type, from its price list.

    materials: tenant_id, id, bid_price, msrp, and name if there is one; finishings: tenant_id, id, unit, bid_price, and name;
    defaults: tenant_id, seq, sign_type, material_id, finishing_ids, width, height, min_price. The first default of a type
    counts; finishings priced by another unit than the square inch add nothing; a tenant without materials has no list.
    """
    named = lambda df: df if "name" in df.columns else df.withColumn("name", F.lit(None).cast("string"))
    materials, finishings = named(materials), named(finishings)
    first = defaults.withColumn("slug", text.sign_type_slug(F.col("sign_type"))).groupBy("tenant_id", "slug").agg(F.min_by(F.struct("material_id", "finishing_ids", "width", "height", "min_price"), "seq").alias("d")).select("tenant_id", "slug", "d.*")
    listed = first.join(materials.select("tenant_id").distinct(), "tenant_id", "left_semi")
    of_material = materials.select("tenant_id", F.col("id").alias("material_id"), F.coalesce("bid_price", "msrp", F.lit(0.0)).alias("_material"), F.col("name").alias("_name"))
    by_area = F.when(F.coalesce("unit", F.lit("")).isin("", "sqin"), F.coalesce("bid_price", F.lit(0.0))).otherwise(0.0)
    each = finishings.select("tenant_id", F.col("id").alias("_id"), by_area.alias("_bid"), F.col("name").alias("_called"))
    # a type has a handful of finishings
    used = listed.select("tenant_id", "slug", F.explode(F.array_distinct("finishing_ids")).alias("_id")).join(each, ["tenant_id", "_id"]).groupBy("tenant_id", "slug").agg(F.sum("_bid").alias("_finishing"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_called"))), lambda x: x["_called"]), ", ").alias("_called"))
    rates = listed.join(of_material, ["tenant_id", "material_id"], "left").join(used, ["tenant_id", "slug"], "left")
    return rates.select("tenant_id", "slug", (F.coalesce("_material", F.lit(0.0)) + F.coalesce("_finishing", F.lit(0.0))).alias("rate"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.coalesce("min_price", F.lit(0)).cast("double").alias("least"), F.coalesce("_name", F.lit("\u2014")).alias("material"), F.coalesce("_called", F.lit("\u2014")).alias("finishing"))


def tenant_pricing_tab(signs: DataFrame, rates: DataFrame, dictionary: DataFrame, installs: DataFrame) -> DataFrame:
    """pricing_tab by the tenants' own lists: unit and extended price, installation.

    rates: as ``tenant_rates`` makes them; dictionary: tenant_id, code, size (the size of a type, before all others), and
    material if there is one (its name, before the list's); installs: tenant_id, default_per_sign, overrides. Everything meets
    on tenant and type after signs are summed up.
    """
    own = tenant_prices(type_summary(signs), rates, dictionary).join(installs, "tenant_id", "left")
    each = install_price(F.col("sign_type"), F.col("default_per_sign"), F.col("overrides"))
    return own.select(*JOB, "sign_type", "qty", "material", "finishing", "unit_price", F.round(F.col("unit_price") * F.col("qty"), 2).alias("extended"), F.round(F.col("qty") * each, 2).alias("installation"))


def tenant_lines(lines: DataFrame, rates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Takeoff or room lines with the unit and extended price of their tenant's own list; ``floor_totals`` adds them up.

    A price depends on tenant and type alone: it is found once for each pair, and those are few.
    """
    types = lines.select("tenant_id", "sign_type").distinct().withColumn("size", dimensions(F.col("sign_type")))
    prices = tenant_prices(types, rates, dictionary).select("tenant_id", "sign_type", "material", F.col("unit_price").alias("_price"))
    joined = lines.join(prices, ["tenant_id", "sign_type"], "left")
    out = joined.withColumn("unit_price", F.col("_price")).withColumn("extended", rounded(F.col("unit_price") * F.col("qty")))
    return out.select(*lines.columns, "material")


def tenant_prices(types: DataFrame, rates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """types (tenant_id, sign_type, size and more) with unit_price, material and finishing by the tenants' own lists."""
    if "material" not in dictionary.columns:
        dictionary = dictionary.withColumn("material", F.lit(None).cast("string"))
    keyed = types.withColumns({"slug": text.sign_type_slug(F.col("sign_type")), "code": F.upper("sign_type")})
    sizes = dictionary.groupBy("tenant_id", F.upper("code").alias("code")).agg(F.max("size").alias("_dictionary"), F.max("material").alias("_of"))
    own = keyed.join(rates, ["tenant_id", "slug"], "left").join(sizes, ["tenant_id", "code"], "left")

    def side(told: Column, i: int) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(told, F.lit("")), _SIZE, i), F.lit("")).cast("double")

    def length(i: int, column: str, default: int) -> Column:
        by_type = F.when(F.coalesce("width", F.lit(0.0)) == 0, side(F.col("size"), i))
        return F.coalesce(side(F.col("_dictionary"), i), by_type, column, F.lit(float(default)))

    flat = text.by_type(F.col("slug"), {k: F.lit(v) for k, v in vocab.FLAT_PRICES.items()}, None)
    by_rate = rounded(F.greatest("least", F.col("rate") * length(1, "width", 6) * length(2, "height", 8)))
    listed = unit_price(F.col("sign_type"), F.when(side(F.col("_dictionary"), 1).isNotNull(), F.col("_dictionary")).otherwise(F.col("size")))
    price = F.coalesce(flat, F.when(F.col("rate").isNotNull(), by_rate).otherwise(listed))
    return own.select(*types.columns, price.alias("unit_price"), F.coalesce("_of", "material").alias("material"), "finishing")


def job_totals(signs: DataFrame) -> DataFrame:
    return pricing_tab(signs).groupBy(*JOB).agg(F.round(F.sum("extended"), 2).alias("material"), F.round(F.sum("installation"), 2).alias("installation"), F.round(F.sum("extended") + F.sum("installation"), 2).alias("total"))


def handoff_pricing(signs: DataFrame) -> DataFrame:
    """Per job, type and size in alphabetical order of type: quantity and price."""
    size = dimensions(F.col("sign_type"))
    out = signs.filter(~F.col("is_deleted")).groupBy(*JOB, "sign_type", size.alias("size")).agg(F.sum("qty").alias("qty"))
    return out.withColumn("price", rounded(unit_price(F.col("sign_type"), F.col("size")) * F.greatest("qty", F.lit(1))))


def legend(signs: DataFrame) -> DataFrame:
    """Per job and type: rows, quantity, confident quantity without rooms that await review."""
    sure = (F.col("confidence") >= vocab.HIGH_CONFIDENCE) & (F.coalesce("review_status", F.lit("")) != "pending")
    return signs.filter(~F.col("is_deleted")).groupBy(*JOB, "sign_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("qty"), F.sum(F.when(sure, F.col("qty")).otherwise(0)).alias("sure_qty"))


def legend_levels(signs: DataFrame) -> DataFrame:
    """Per job and level, in the legend's order (``position``): rows, quantity, and quantity without signs of rooms that were
    seen on an image and await review (room_source, review_status). Levels that no word orders come last, by name.
    """
    low = F.lower("level")
    place = F.coalesce(*(F.when(low.contains(w), F.lit(i)) for i, w in enumerate(vocab.LEGEND_LEVELS)))
    waits = F.coalesce((F.col("room_source") == "ai_vision") & (F.col("review_status") == "pending"), F.lit(False))
    qty = F.coalesce("qty", F.lit(1))
    levels = signs.filter(~F.col("is_deleted")).withColumn("level", F.coalesce("floor_label", F.lit("Unassigned"))).groupBy(*JOB, "level").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(qty).alias("qty"), F.sum(F.when(waits, 0).otherwise(qty)).alias("sure_qty"))
    order = Window.partitionBy(*JOB).orderBy(place.asc_nulls_last(), "level")
    return levels.withColumn("position", F.row_number().over(order))


def flat_price(sign_type: Column, own: Column | None = None) -> Column:
    """Estimation price: that of the first key, in list order, which the type contains. own: a job's map of prices,
    which replace those of the list; its further keys come after the list's, ``default`` is the price of the rest."""
    low = F.lower(sign_type)
    of = lambda k, v: F.lit(v) if own is None else F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(v))
    found = text.first_of(*((F.contains(low, F.lit(k.lower())), of(k, v)) for k, v in vocab.ESTIMATES.items()))
    other = of("default", vocab.OTHER_ESTIMATE)
    if own is None:
        return F.coalesce(found, other)
    more = F.filter(F.map_entries(own), lambda e: (e["key"] != "default") & ~e["key"].isin(*vocab.ESTIMATES) & F.contains(low, F.lower(e["key"])))
    return F.coalesce(found, F.get(more, F.lit(0))["value"], other)
