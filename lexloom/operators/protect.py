"""Protected tokens: brands, abbreviations, units and currencies keep their form through a correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.matching import deletes

# Protected entities by category; a category of several wins in this order.
BRANDS = (
    "ASUS,OPPO,POCO,REALME,VIVO,SAMSUNG,LG,SONY,INTEL,AMD,NVIDIA,BOSCH,DYSON,NIKON,CANON,GOPRO,RAZER,CORSAIR,STEELSERIES,LOGITECH,DELL,HP,LENOVO,"
    "APPLE,MICROSOFT,GOOGLE,META,QUALCOMM,MEDIATEK,SHEIN,H&M,ZARA,GUCCI,PRADA,LOUIS VUITTON,NIKE,ADIDAS,PUMA,REEBOK,NEW BALANCE,FILA,LACOSTE,"
    "RALPH LAUREN,TOMMY HILFIGER,CALVIN KLEIN,UNIQLO,IKEA,ZWILLING,TRAMONTINA,KITCHENAID,VITAMIX,INSTANT POT,LE CREUSET,LODGE,OXLEY,NESTLÉ,COCA COLA,"
    "PEPSI,KRAFT,HEINZ,KELLOGG'S,GENERAL MILLS,MONDELEZ,DANONE,YOPLAIT,HÄAGEN-DAZS,LINDT,GODIVA,FERRERO,MARS,SNICKERS,M&M'S,MICHELIN,GOODYEAR,"
    "BRIDGESTONE,DUNLOP,PIRELLI,SHELL,MOBIL,CASTROL,VALVOLINE,MOTUL,LEGO,MATTEL,HASBRO,FISHER PRICE,BARBIE,HOT WHEELS,DECATHLON,SPALDING,WILSON,PING,TITLEIST"
).split(",")
ABBREVIATIONS = (
    "GPU,CPU,RAM,SSD,HDD,PSU,MOB,RTX,GTX,RX,GFX,VRAM,LPDDR,DDR3,DDR4,DDR5,USB,HDMI,VGA,DVI,DP,MINI DP,TYPE C,USBC,WIFI,BT,4G,5G,LTE,3G,NFC,RFID,"
    "GB,TB,MB,KB,GBS,TBS,MBS,KBS,FPS,HZ,KHZ,MHZ,GHZ,DPI,RPM,TPM,SIM,LED,OLED,LCD,QHD,FHD,UHD,4K,8K,PCS,PIECES,QTY,DOZ,PKG,PKT,BOX,SET,PACK,CARTON,CASE,"
    "LOT,BULK,PX,PT,IN,FT,YD,MI,KM,M,CM,MM,KG,G,LBS,OZ,TON,MG,L,ML,GAL,QUART,PINT,CUP,FL OZ,IU,MCG,MCGS"
).split(",")
UNITS = "KG,G,ML,L,M,CM,MM,KM,LBS,OZ,TON,IN,FT,YD,MI,GAL,QUART,PINT,CUP,TBSP,TSP,FL OZ,GHZ,MHZ,HZ,DPI,PPI,RPM,PSI,BAR,WATTS,AMPS".split(",")
CURRENCIES = (
    "$,€,£,¥,₹,₺,₽,₩,₪,₦,₨,₱,₡,₲,₵,₴,₸,฿,៛,₾,₿,USD,EUR,GBP,JPY,INR,CNY,AUD,CAD,CHF,SEK,NZD,MXN,SGD,HKD,NOK,KRW,TRY,RUB,BRL,ZAR,AED,SAR,QAR,KWD,BHD,OMR"
).split(",")
ENTITIES = {"brand": BRANDS, "abbreviation": ABBREVIATIONS, "unit": UNITS, "currency": CURRENCIES}


def category(c: Column) -> Column:
    """The category of an entity as it stands; NULL for any other token."""
    w = F.upper(F.trim(c))
    out = F.lit(None).cast("string")
    for name in reversed(ENTITIES):
        out = F.when(w.isin(ENTITIES[name]), F.lit(name)).otherwise(out)
    return out


def entity_table(spark) -> DataFrame:
    """``entity, category``: a few hundred fixed rows, one for each entity, the first category that holds it."""
    seen: dict[str, str] = {}
    for name, words in ENTITIES.items():
        for w in words:
            seen.setdefault(w, name)
    return spark.createDataFrame(sorted(seen.items()), "entity string, category string")


def lookup(df: DataFrame, token: str, entities: DataFrame) -> DataFrame:
    """``token, entity, category, distance`` of distinct tokens: equal, or one edit away (letters wrong, missing, extra).

    Ties go to the first entity by name. Candidates meet in a hash join on what is left without one letter.
    """
    w = df.select(F.col(token).alias("token")).distinct().withColumn("u", F.upper(F.trim("token"))).filter("u <> ''")
    a = w.withColumn("d", F.explode(deletes(F.col("u"))))
    b = entities.withColumn("d", F.explode(deletes(F.col("entity"))))
    # the entities are a fixed list of a few hundred words
    near = a.join(F.broadcast(b), "d").select("token", "u", "entity", "category").distinct()
    near = near.withColumn("distance", F.levenshtein("u", "entity", 1)).filter("distance between 0 and 1")
    best = Window.partitionBy("token").orderBy("distance", "entity")
    return near.withColumn("r", F.row_number().over(best)).filter("r = 1").select("token", "entity", "category", "distance")


def protected_prefix(token: Column, fuzzy: bool = False) -> Column:
    """``struct<entity, category, rest>``: the longest start of a token that is an entity; NULL where none is.

    With ``fuzzy`` a start within one edit of an entity counts as well; every token then starts with one, since any
    letter is one edit away from a one-letter unit.
    """
    names = F.array(*[F.lit(w) for words in ENTITIES.values() for w in dict.fromkeys(words)])
    up = F.upper(token)

    def at(n: Column) -> Column:
        start = F.substring(up, F.lit(1), n)
        if not fuzzy:
            return F.struct(n.alias("n"), F.when(category(start).isNotNull(), start).alias("entity"))
        near = F.array_sort(F.transform(F.filter(names, lambda e: F.levenshtein(e, start) <= 1), lambda e: F.struct(F.levenshtein(e, start).alias("d"), e.alias("e"))))
        return F.struct(n.alias("n"), F.get(near, F.lit(0))["e"].alias("entity"))

    lengths = F.sequence(F.greatest(F.length(token), F.lit(1)), F.lit(1), F.lit(-1))
    hit = F.get(F.filter(F.transform(lengths, at), lambda x: x["entity"].isNotNull()), F.lit(0))
    rest = F.substring(token, hit["n"] + 1, F.length(token))
    return F.when(hit.isNotNull(), F.struct(hit["entity"].alias("entity"), category(hit["entity"]).alias("category"), rest.alias("rest")))


def protect(query: Column) -> Column:
    """``struct<masked, spans>``: each token's protected start as ``[CATEGORY_n]`` and its position in the single-spaced query."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<pos:int,entity:string,category:string>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        p = protected_prefix(t)
        name = F.concat(F.lit("["), F.upper(p["category"]), F.lit("_"), F.size(acc["spans"]).cast("string"), F.lit("]"), p["rest"])
        span = F.array(F.struct(acc["at"].alias("pos"), p["entity"].alias("entity"), p["category"].alias("category")))
        return F.struct(
            (acc["at"] + F.length(t) + 1).alias("at"), F.concat(acc["out"], F.array(F.when(p.isNull(), t).otherwise(name))).alias("out"),
            F.when(p.isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"),
        )

    done = F.aggregate(tokens(query), zero, step)
    return F.struct(F.array_join(done["out"], " ").alias("masked"), done["spans"].alias("spans"))


def merge_corrections(original: Column, model: Column) -> Column:
    """The model's tokens with the original's protected starts; missing ones from the original, extra ones dropped.

    Where the numbers of tokens differ by more than two the model's text stands.
    """
    a, b = tokens(original), tokens(model)

    def at(i: Column) -> Column:
        o, m = F.get(a, i), F.get(b, i)
        p = protected_prefix(o)
        kept = F.when(p["rest"] == "", p["entity"]).when(F.contains(F.lower(m), F.lower(p["rest"])), o).otherwise(F.concat(p["entity"], F.substring(m, F.length(p["entity"]) + 1, F.length(m))))
        return F.when(m.isNull(), o).when(p.isNull(), m).otherwise(kept)

    merged = F.when(F.size(a) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(1)) - 1), at), " ")).otherwise(F.lit(""))
    return F.when(F.abs(F.size(a) - F.size(b)) > 2, model).otherwise(merged)


def _masked_runs(query: Column, pattern: str, kind: str, keep) -> Column:
    """Matches of a pattern that ``keep`` accepts, replaced where they stand by ``[kind_n]``; ``struct<masked, values>``."""
    gaps = F.split(F.regexp_replace(query, pattern, "\u0001"), "\u0001", -1)
    hits = F.regexp_extract_all(query, F.lit(pattern), F.lit(0))
    zero = F.struct(F.get(gaps, F.lit(0)).alias("out"), F.lit(1).alias("i"), F.array().cast("array<string>").alias("values"))

    def step(acc: Column, h: Column) -> Column:
        ok = keep(h)
        new = F.when(ok, F.concat(F.lit(f"[{kind}_"), F.size(acc["values"]).cast("string"), F.lit("]"))).otherwise(h)
        return F.struct(F.concat(acc["out"], new, F.get(gaps, acc["i"])).alias("out"), (acc["i"] + 1).alias("i"), F.when(ok, F.concat(acc["values"], F.array(h))).otherwise(acc["values"]).alias("values"))

    done = F.aggregate(hits, zero, step)
    return F.struct(done["out"].alias("masked"), done["values"].alias("values"))


def mask_units(query: Column) -> Column:
    """Numbers with a known unit or abbreviation as ``[NUM_UNIT_n]``."""
    return _masked_runs(query, r"\d+(?:\.\d+)?\s*[a-zA-Z%]+", "NUM_UNIT", lambda h: F.upper(F.regexp_extract(h, r"([a-zA-Z%]+)$", 1)).isin(UNITS + ABBREVIATIONS))


def mask_prices(query: Column) -> Column:
    """Amounts with a currency sign or code in front as ``[PRICE_n]``; amounts of several digits too."""
    return _masked_runs(query, r"(?:[$€£¥₹₺]|\b[A-Za-z]{3})\s*\d+(?:\.\d+)?", "PRICE", lambda h: F.upper(F.regexp_extract(h, r"^([^\s\d]+)", 1)).isin(CURRENCIES))


def mask_prices_v1(query: Column) -> Column:
    """The first form of `mask_prices`, whose currency part takes digits: ``$99.99`` is left alone, ``$5`` is not."""
    return _masked_runs(query, r"[$€£¥₹₺\w]{1,3}\s*\d+(?:\.\d+)?", "PRICE", lambda h: F.upper(F.regexp_extract(h, r"^([$€£¥₹₺\w]{1,3})\s*\d+(?:\.\d+)?$", 1)).isin(CURRENCIES))


def statistics(spark) -> DataFrame:
    """``category, n``: distinct entities of each list, and all together."""
    rows = [(k, len(set(v))) for k, v in ENTITIES.items()]
    return spark.createDataFrame([*rows, ("all", len(set().union(*ENTITIES.values())))], "category string, n bigint")
