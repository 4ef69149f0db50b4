"""Small dimension tables, as plain values: they are a few rows each and are broadcast."""

# Words of events by the kind of tool use they stand for; a whole match comes before a part of the name.
TOOL_SYNONYMS = (("purchase", "satisfies"), ("click", "uses"), ("sign", "defines"), ("view", "related-to"), ("err", "depends-on"))

# Domain aliases and their variants.
ALIASES = {"bolt": ("screw", "fastener"), "ring": ("washer", "hoop"), "widget": ("gadget",), "gear": ("cog",), "small": ("mini",), "large": ("big",)}

# Names that are too common to be nodes.
STOPWORDS = ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "part", "item", "type", "use", "was", "on", "are", "as", "with", "this", "be", "at", "by", "from")

# Endings of event-like words and of abstract words.
EVENT_ENDINGS = ("tion", "ing", "ment", "tiones")
ABSTRACT_ENDINGS = ("ness", "ity", "ance", "ence")

# Prices in dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 3.0, 15.0

# What an answer says when it declines.
REFUSALS = ("検証不能", "根拠不在", "確認できません", "検出されませんでした", "見当たりません", "該当箇所は提示できません", "存在しません", "示す条文はありません", "規定する条文は検出")
