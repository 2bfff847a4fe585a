"""Word lists, weights and thresholds that results depend on."""

# Every list and number in this module has to be as it is for results to agree.

ATTRIBUTES = ("material", "color", "size", "style", "use_case", "feature", "budget")
ASKABLE = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")

#: Words that name an attribute's value in catalog texts, as alternatives of a pattern.
CATALOG_VALUES = {
    "material": "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric",
    "color": "black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange",
    "style": "casual|formal|vintage|sporty|elegant|bohemian|minimalist|streetwear",
    "use_case": "office|gym|outdoor|beach|wedding|party|work|travel|hiking|running|winter",
    "feature": "waterproof|breathable|lightweight|stretchy|slim|oversized|elastic|zip|pocket|lace.up|drawstring",
}

#: Ways in which a text states a size, in the order they are tried; group 1 is the size.
SIZE_PATTERNS = (
    r"\bsize\s*[:=]?\s*(xs|s|m|l|xl|xxl)\b",
    r"\b(xs|xxl|xl|small|medium|large|extra large|one size|plus size|petite|tall|wide|narrow)\b",
    r"\b((?:xs|s|m|l|xl|xxl)\s*(?:[/\-]\s*(?:xs|s|m|l|xl|xxl)){1,3})\b",
    r"\b(?:us|size)\s*[:=]?\s*(\d{1,2}(?:\.\d)?)\b",
)

#: Words that name an attribute's value when a shopper excludes it.
EXCLUDABLE_VALUES = {
    "material": r"cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric|denim|linen|suede|velvet",
    "color": r"black|white|blue|red|pink|green|brown|gr[ae]y|purple|yellow|orange|navy|beige",
    "size": r"xs|xxl|xl|small|medium|large|extra large|one size|plus size|petite|tall|wide|narrow",
    "style": r"casual|formal|vintage|sporty|elegant|bohemian|minimalist|streetwear|slim fit|oversized",
    "use_case": r"office|gym|outdoor|beach|wedding|party|daily|work|travel|hiking|running|winter",
    "feature": r"waterproof|breathable|lightweight|stretchy|anti-slip|elastic|zip|pocket|lace.up|drawstring",
}

#: What stands before a value that a shopper excludes, with up to three words between.
NEGATION = r"(?:\bnot|\bno|\bwithout|\bavoid|\bexclude|\bexcept|\banything but|\bdon't want|\bdo not want)\s+(?:\w+\s+){0,3}$"
NEGATION_REACH = 48

#: A shopper without preference for an attribute (group 1), up to the end of the clause.
NO_PREFERENCE = (
    r"(?:i\s+)?(?:do not|don't|dont|no)\s+(?:have\s+)?(?:an?\s+)?(?:additional\s+)?preference\s+(?:for|on)\s+"
    r"(material|color|size|style|use[_ ]case|feature|budget|brand|category)[^.;]*[.;]?"
)

#: Patterns for slots in free text, in the order they are tried; group 1 is the value.
SLOT_PATTERNS = {
    "color": (r"\b(black|white|red|blue|green|pink|grey|gray|brown|navy|beige|yellow|purple|orange)\b",),
    "size": SIZE_PATTERNS,
    "brand": (r"\b(nike|adidas|levi(?:'s)?|zara|gucci|puma|reebok|calvin klein|h&m|uniqlo)\b",),
    "budget": (r"under \$?(\d+)", r"less than \$?(\d+)", r"\$?(\d+)\s*or less", r"budget[^\d]*(\d+)"),
    "material": (r"\b(cotton|leather|polyester|wool|silk|denim|linen|nylon|suede|velvet|spandex|rayon|fabric)\b",),
    "style": (r"\b(casual|formal|vintage|sporty|elegant|bohemian|minimalist|streetwear)\b",),
    "use_case": (r"\b(office|gym|outdoor|beach|wedding|party|daily|work|travel|hiking|running|winter)\b",),
    "category": (r"\b(shoes|sneakers|boots|sandals|dress|shirt|jacket|pants|jeans|bag|hat|watch|ring|necklace|coat|skirt|shorts)\b",),
    "feature": (r"\b(waterproof|breathable|lightweight|stretchy|slim fit|oversized|long sleeve|short sleeve|anti-slip)\b",),
}

#: Parts of a constraint's text that decide its kind, in the order they are tried.
BUDGET_HINT = r"budget|(?:\$|<=|under)\s*\d"
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")
SHORT_COLORS = ("black", "white", "blue", "red", "pink", "green")
SIZE_HINTS = ("size", "sizing", "width", "wide", "narrow")
STYLE_HINTS = ("department", "style", "fit", "sleeve", "neck")
USE_HINTS = ("hiking", "running", "gym", "winter", "outdoor", "work")

#: What messages of a session look like.
MATTERS = r"what matters is:\s*(.+?)\.?\s*$"
REQUIREMENT = r"a key requirement is:\s*(.+?)\.?\s*$"
NEED = r"what i need is:\s*(.+?)\.?\s*$"
LOOKING = r"looking for\s+([^.;]+?)(?:\s*\.|$)"
OVERRIDE = "ignore my earlier preference"
BOUNDARY = "please use your judgment"
BUYING = "a key requirement is:"
NOISE = ("use your judgment", "not quite right")
ROOT_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")

QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking",
    "key", "requirement", "matters", "preference", "need", "actually",
    "ignore", "earlier", "just", "also",
)
DIVERSITY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
    "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking",
    "color", "size", "style", "material", "feature", "use", "case", "budget",
    "brand",
)
PROFILE_SYNONYMS = {
    "comfort": ("comfort", "comfortable"),
    "durability": ("durability", "durable"),
    "fit": ("fit", "fitted", "fitting"),
    "warmth": ("warmth", "warm"),
}

FIELD_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "description": 2.5, "store": 1.5, "details": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
GLOBAL_ENTROPY = {"material": 0.73, "color": 0.77, "size": 0.53, "style": 0.67, "use_case": 0.87, "feature": 0.71, "budget": 0.79}
ATTRIBUTE_PRIORS = {
    "category": 1.15, "feature": 1.10, "material": 1.05, "use_case": 1.05, "color": 1.00, "size": 1.00, "style": 1.00,
    "brand": 1.00, "budget": 0.90,
}
