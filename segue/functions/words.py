"""Word lists of the namer."""

from __future__ import annotations

#: Adjectives by kind, kinds in the order in which English puts them.
ADJECTIVES = {
    "Opinion": ("Dark", "Ethereal", "Minimal", "Deep", "Intense", "Subtle", "Bright", "Raw", "Polished", "Gritty", "Smooth", "Rough", "Clean", "Pure", "Harsh"),
    "Size": ("Vast", "Dense", "Massive", "Compact", "Expansive", "Intimate", "Wide", "Narrow"),
    "Age": ("Late", "Ancient", "New", "Fresh", "Vintage", "Modern", "Classic"),
    "Shape": ("Geometric", "Flowing", "Angular", "Curved", "Round", "Linear", "Jagged"),
    "Color": ("Midnight", "Amber", "Azure", "Crimson", "Golden", "Silver", "Obsidian"),
    "Origin": ("Nordic", "Urban", "Tribal", "Industrial", "Tropical", "Cosmic", "Digital", "Analog"),
    "Material": ("Metallic", "Organic", "Synthetic", "Wooden", "Crystal"),
    "Purpose": ("Driving", "Hypnotic", "Dancing", "Focusing", "Relaxing", "Energizing"),
}
ADJECTIVE_RANK = {w: k for k, words in enumerate(ADJECTIVES.values()) for w in words}

#: Synonyms, tried in this order.
SYNONYMS = {
    "Dark": ("Shadowed", "Dim", "Nocturnal", "Obscure", "Gloomy"),
    "Bright": ("Luminous", "Radiant", "Brilliant", "Vivid", "Gleaming"),
    "Deep": ("Profound", "Bottomless", "Submerged", "Abyssal", "Low"),
    "Intense": ("Extreme", "Fierce", "Severe", "Powerful", "Strong"),
    "Smooth": ("Sleek", "Velvety", "Silky", "Polished", "Refined"),
    "Vast": ("Immense", "Boundless", "Endless", "Infinite", "Expansive"),
    "Driving": ("Propulsive", "Pulsing", "Thrusting", "Pushing", "Moving"),
    "Ethereal": ("Celestial", "Heavenly", "Airy", "Delicate", "Light"),
    "Minimal": ("Sparse", "Stripped", "Reduced", "Simple", "Bare"),
    "Geometric": ("Structured", "Patterned", "Angular", "Regular", "Ordered"),
    "Nordic": ("Scandinavian", "Arctic", "Northern", "Polar", "Baltic"),
    "Urban": ("Metropolitan", "City", "Street", "Downtown", "Concrete"),
    "Organic": ("Natural", "Living", "Biological", "Earthy", "Raw"),
    "Hypnotic": ("Mesmerizing", "Trance", "Enchanting", "Spellbinding", "Magical"),
    "Industrial": ("Mechanical", "Factory", "Steel", "Machine", "Synthetic"),
}

#: What follows a name that is taken.
ROMAN = ("II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
