"""Product attributes: the slots A1 to A18 of a product's metadata, by a category's configuration.

Products have asin, parent_asin, title, brand, price, category, categories (arrays), features (array), description and
details (JSON text).  Everything is a column expression over one row, so nothing is shuffled.

Null and blank fields give null scalars and empty arrays or maps; details that are no JSON object have no keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Words that tell a use, by kind, in the order that settles ties.
PEOPLE = (
    "kids", "children", "beginners", "professionals", "men", "women", "teens", "adults", "seniors", "students", "teachers", "artists",
)
PLACES = (
    "home", "office", "school", "classroom", "studio", "workshop", "outdoor", "indoor", "garden", "bedroom", "kitchen", "bathroom",
)
ACTIVITIES = (
    "travel", "camping", "hiking", "commuting", "exercise", "fitness", "sport", "sports", "running", "cycling", "swimming", "yoga", "meditation",
    "painting", "drawing", "sewing", "crafting", "scrapbooking", "jewelry", "knitting", "crocheting", "embroidery", "quilting", "woodworking",
    "gardening", "cooking", "baking", "photography", "writing", "journaling",
)
EVENTS = (
    "gift", "party", "wedding", "birthday", "christmas", "holiday", "seasonal", "easter", "halloween", "thanksgiving", "valentine",
)
INFANTS = ("baby", "infant", "newborn", "toddler")
KEEPING = ("organizing", "storage", "display", "presentation")
LEARNING = ("playing", "learning", "development", "entertainment")
# Of each kind the words looked for after "for ", and those looked for alone.
USES = (
    ((*PEOPLE, "babies", "toddlers"), PEOPLE),
    (INFANTS, INFANTS),
    ((*PLACES, "garage", "playroom"), PLACES),
    (ACTIVITIES, ACTIVITIES),
    ((*EVENTS, "anniversary"), EVENTS),
    (KEEPING, KEEPING),
    (("feeding", "nursing", "bathing", "sleeping", "diaper changing", "potty training", "teething"), ("feeding", "nursing", "bathing", "sleeping", "diaper", "potty", "teething")),
    (LEARNING, LEARNING),
)
# Names of activities that stand after "used for"; none for those that say nothing.
ACTIVITY_NAMES = {
    "doing": None, "making": "Making", "creating": "Creating", "decorating": "Decorating", "decoration": "Decorating", "cutting": "Cutting",
    "shaping": "Shaping", "carving": "Carving", "painting": "Painting", "drawing": "Drawing", "sewing": "Sewing", "crafting": "Crafting",
    "scrapbooking": "Scrapbooking", "candle": "Candle Making", "soap": "Soap Making", "cake": "Cake Decorating", "clay": "Clay Craft",
    "all kinds of": None, "various": None,
}
# Keys of details that make up A6, the first that is filled counting.
DETAILS = {
    "target_species": ("Target Species",), "age_range": ("Age Range", "Age Range Description"), "size": ("Size",), "material": ("Material",),
    "color": ("Color",), "item_form": ("Item Form",), "special_feature": ("Special Feature",), "fit_type": ("Fit Type",), "theme": ("Theme",), "brand": ("Brand",),
}
# Slots filled from words of the description.
WORD_SLOTS = {
    "A8_safety": (
        "safe", "safety", "non-toxic", "nontoxic", "hypoallergenic", "bpa-free", "bpa free", "lead-free", "lead free", "phthalate-free", "flame-retardant",
        "eco-friendly", "organic", "natural", "chemical-free", "chemical free", "toxin-free",
    ),
    "A9_durability": ("durable", "durability", "long-lasting", "long lasting", "heavy duty", "sturdy", "strong", "reinforced", "robust", "solid", "high quality", "premium"),
    "A10_ease_of_use": (
        "easy", "easy to use", "simple", "convenient", "user-friendly", "intuitive", "effortless", "quick", "hassle-free", "ready to use", "pre-assembled", "easy to clean",
    ),
    "A11_temperature_resistance": (
        "heat resistant", "heat-resistant", "cold resistant", "cold-resistant", "waterproof", "weatherproof", "uv resistant", "fade-resistant", "heat tolerance",
    ),
    "A12_surface": ("smooth", "textured", "anti-slip", "non-slip", "rubberized", "padded", "mesh"),
    "A13_reusability": (
        "reusable", "washable", "disposable", "one-time use", "multi-use", "refillable", "recyclable", "eco-friendly", "sustainable", "biodegradable",
    ),
}
# Slots filled from keys of details, and how many values each may hold.
KEY_SLOTS = {
    "A7_material": (("Material",), 1),
    "A14_size": (("Size", "Item Dimensions LxWxH", "Package Dimensions", "Product Dimensions"), 3),
    "A15_weight": (("Item Weight",), 1),
    "A16_compatibility": (("Target Species", "Age Range", "Age Range Description", "Target Audience", "Sport"), 3),
    "A17_flavor": (("Flavor",), 1),
}
MIN_SLOTS = 5
# Words of a description that tell quality, and those that tell colour or style.
QUALITY = (
    "high quality", "premium", "professional", "durable", "sturdy", "excellent", "superior", "top quality", "best", "fine", "perfect", "reliable", "solid",
    "heavy duty", "industrial",
)
APPEARANCE = (
    "black", "white", "red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "gray", "grey", "silver", "gold", "clear", "transparent", "neon",
    "pastel", "vibrant", "multicolor", "assorted", "beautiful", "elegant", "stylish", "modern", "classic", "vintage", "decorative", "ornamental", "cute", "pretty",
    "lovely", "charming", "minimalist", "simple", "fancy", "delicate", "exquisite",
)
#: A shorter description tells nothing.
MIN_DESCRIPTION = 20


@dataclass(frozen=True)
class Category:
    """What a category looks for; the defaults are those of baby products."""

    uses: Sequence[tuple[Sequence[str], Sequence[str]]] = USES
    details: Mapping[str, Sequence[str]] = field(default_factory=lambda: DETAILS)
    word_slots: Mapping[str, Sequence[str]] = field(default_factory=lambda: WORD_SLOTS)
    key_slots: Mapping[str, tuple[Sequence[str], int]] = field(default_factory=lambda: KEY_SLOTS)
    min_slots: int = MIN_SLOTS

    def use_keywords(self) -> list[str]:
        """The words for uses, longest first."""
        found = [word for after, alone in self.uses for word in (*(f"for {w}" for w in after), *alone)]
        return sorted(found, key=len, reverse=True)


def detail_map(details: Column) -> Column:
    """The keys and texts of a JSON object; empty for anything else."""
    return F.coalesce(F.from_json(details, "map<string,string>"), F.create_map().cast("map<string,string>"))


def filled(details: Column, key: str) -> Column:
    """The text of a key, trimmed; null if it has none."""
    return F.when(F.coalesce(F.try_element_at(details, F.lit(key)), F.lit("")) != "", F.btrim(F.try_element_at(details, F.lit(key))))


def detailed(details: Column, names: Mapping[str, Sequence[str]] = DETAILS) -> Column:
    """A6: a map of the names whose keys are filled."""
    entries = F.array(*(F.struct(F.lit(name).alias("key"), F.coalesce(*(filled(details, key) for key in keys)).alias("value")) for name, keys in names.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def values_of(details: Column, keys: Sequence[str], most: int) -> Column:
    return F.slice(F.array_compact(F.array(*(filled(details, key) for key in keys))), 1, most)


def words_of(description: Column, keywords: Sequence[str]) -> Column:
    """The keywords that the lower-cased text holds, hyphens as spaces and words capitalized, each once."""
    held = lambda low: F.array(*(F.when(low.contains(word), F.lit(word.replace("-", " ").title())) for word in keywords))
    return F.array_distinct(F.array_compact(tx.bound(F.lower(F.coalesce(description, F.lit(""))), held)))


def description_words(description: Column, keywords: Sequence[str], shortest: int = MIN_DESCRIPTION) -> Column:
    """The keywords that a description holds anywhere, without tags and in any case, the first letter capitalized; none if it is short or null."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    words = F.array(*map(F.lit, keywords))
    held = lambda text: tx.bound(F.lower(text), lambda low: F.transform(F.filter(words, lambda word: F.contains(low, word)), tx.capitalized))
    return tx.bound(text, lambda text: F.when(F.length(text) >= shortest, held(text)).otherwise(F.array().cast("array<string>")))


def kept_features(features: Column) -> Column:
    """The first five features of 4 to 199 characters, without tags."""
    clean = F.transform(F.coalesce(features, F.array().cast("array<string>")), lambda f: F.btrim(f))
    long = F.filter(clean, lambda f: F.length(f).between(4, 199))
    return F.slice(F.filter(F.transform(long, lambda f: F.btrim(F.regexp_replace(f, "<[^>]+>", ""))), lambda f: f != ""), 1, 5)


def use_case(title: Column, description: Column, features: Column, category: Category) -> Column:
    """A5: the longest word for a use that the text holds, else what stands after "used for"."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    text = F.regexp_replace(F.concat_ws(" ", low, F.array_join(F.coalesce(features, F.array().cast("array<string>")), " ")), "<[^>]+>", " ")

    def named(activity: Column) -> Column:
        out = tx.capitalized(activity)
        for word, name in ACTIVITY_NAMES.items():
            out = F.when(activity == word, F.lit(name)).otherwise(out)
        return F.when(F.length(activity).between(3, 30), out)

    def found(text: Column) -> Column:
        # Fixed value: the pattern of an activity.
        activity = F.regexp_replace(F.regexp_extract(text, r"(?:be\s+)?used\s+for\s+([a-zA-Z][a-zA-Z\s]+?)(?:\s|,|\.|$)", 1), r"\s+", " ")
        # A filter over the list instead of nested conditions: the first that the text holds is the longest.
        held = F.get(F.filter(F.array(*map(F.lit, category.use_keywords())), lambda w: F.contains(text, w)), F.lit(0))
        return F.coalesce(tx.bound(F.regexp_replace(held, "^for ", ""), tx.capitalized), tx.bound(activity, named))

    return tx.bound(text, found)


def product_attributes(products: DataFrame, category: Category = Category(), appearance: Column | None = None, quality: Column | None = None) -> DataFrame:  # noqa: B008
    """One row a product: asin, A1 to A18, features, n_slots (filled slots) and reason (why it is rejected; null if it isn't).

    quality fills A18, by default the QUALITY words of the description; appearance fills A4, which has rules of its own and is empty by
    default (the APPEARANCE words of a description are no part of it).
    """
    none = F.array().cast("array<string>")
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    last = F.try_element_at("categories", F.lit(-1))
    base = products.withColumn("_m", detail_map(F.col("details"))).select(
        F.coalesce(F.nullif("asin", F.lit("")), "parent_asin").alias("asin"),
        "title", "description", "features", "_m",
        F.coalesce(F.nullif("brand", F.lit("")), F.nullif(F.try_element_at("_m", F.lit("Brand")), F.lit(""))).alias("_b"),
        F.when(F.size(F.coalesce("category", none)) > 0, F.col("category")).when(last.isNotNull(), F.array(last)).alias("_c"),
        F.coalesce(F.nullif("price", F.lit("")), tx.price_in_text(F.concat_ws(" ", "title", "description", F.array_join("features", " ")))).alias("_p"),
        (none if appearance is None else appearance).alias("A4_appearance"),
        (description_words(F.col("description"), QUALITY) if quality is None else quality).alias("A18_quality"),
    )
    slots = {
        "A1_product_type": tx.product_type(F.col("_c")),
        "A2_brand": F.when(~blank(F.col("_b")), F.col("_b")),
        "A3_price": tx.price(F.col("_p")),
        "A4_appearance": F.col("A4_appearance"),
        "A5_use_case": use_case(F.col("title"), F.col("description"), F.col("features"), category),
        "A6_detailed": detailed(F.col("_m"), category.details),
        **{name: values_of(F.col("_m"), keys, most) for name, (keys, most) in category.key_slots.items()},
        **{name: words_of(F.col("description"), words) for name, words in category.word_slots.items()},
        "A18_quality": F.col("A18_quality"),
    }
    order = sorted(slots, key=lambda name: int(name[1:].split("_")[0]))
    told = base.select("asin", "_b", "_c", "_p", kept_features(F.col("features")).alias("features"), *(slots[name].alias(name) for name in order))
    scalars = {"A1_product_type", "A2_brand", "A3_price", "A5_use_case"}
    count = sum(((F.col(name).isNotNull() if name in scalars else F.size(name) > 0).cast("int") for name in order), F.lit(0))
    reason = (
        F.when(F.coalesce("asin", F.lit("")) == "", "no_asin")
        .when(F.col("_b").isNull(), "no_brand")
        .when(F.col("_c").isNull(), "no_category")
        .when(F.lower(F.btrim("_b")).isin(*tx.NO_BRANDS), "invalid_brand")
        .when(F.col("_p").isNull(), "no_price")
        .when(F.col("n_slots") < category.min_slots, "few_slots")
    )
    return told.withColumn("n_slots", count).withColumn("reason", reason).select("asin", *order, "features", "n_slots", "reason")
