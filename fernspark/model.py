"""Enumerations, vocabularies and constants of the domain."""

from __future__ import annotations

#: Enumerations of the data model.
SPECIES = ["dog", "cat", "rabbit", "bird", "small_furry", "reptile", "horse", "barnyard", "other"]
AGES = ["baby", "young", "adult", "senior"]
SEXES = ["male", "female", "unknown"]
SIZES = ["xs", "s", "m", "l", "xl"]
ENERGY = ["low", "moderate", "high", "very_high"]
COATS = ["hairless", "short", "medium", "long", "wire", "curly"]
STATUSES = ["available", "pending", "adopted", "removed"]
TRI = ["true", "false", "unknown"]
RADII = [10, 25, 50, 100]
SEARCH_SPECIES = ["dog", "cat", "rabbit", "bird", "other"]

#: Kinds of the feeds that the readers know, and labels under which kinds are shown (others: the source itself).
WIDGET_SOURCE, PAGE_SOURCE = "asm3", "rescuegroups"
SOURCE_LABELS = {"asm3": "sheltermanager.com"}

#: Vocabularies of the widget feed; a name that is not listed is 'other' (species) or absent.
WIDGET_SPECIES = {
    "dog": "dog", "cat": "cat", "rabbit": "rabbit", "bird": "bird", "guinea pig": "small_furry", "hamster": "small_furry",
    "rat": "small_furry", "mouse": "small_furry", "ferret": "small_furry", "reptile": "reptile", "snake": "reptile",
    "lizard": "reptile", "tortoise": "reptile", "horse": "horse", "pony": "horse", "goat": "barnyard", "pig": "barnyard",
}
WIDGET_SIZES = {"very small": "xs", "small": "s", "medium": "m", "large": "l", "very large": "xl", "x-large": "xl"}
WIDGET_AGES = {"baby": "baby", "puppy": "baby", "kitten": "baby", "young": "young", "young adult": "young", "adult": "adult", "senior": "senior", "aged": "senior"}
#: Vocabularies of the page feed.
PAGE_SPECIES = {"dog": "dog", "cat": "cat", "rabbit": "rabbit", "bird": "bird", "small animal": "small_furry", "reptile": "reptile", "horse": "horse", "farm animal": "barnyard"}
PAGE_AGES = {"baby": "baby", "young": "young", "adult": "adult", "senior": "senior"}
PAGE_SIZES = {"small": "s", "medium": "m", "large": "l", "x-large": "xl"}

#: What a tag says, by its normalised key.
TAG_RULES = {
    "good with kids": ("kids", "true"), "kid-friendly": ("kids", "true"), "kid friendly": ("kids", "true"), "children ok": ("kids", "true"),
    "no small children": ("kids", "false"), "good with dogs": ("dogs", "true"), "no dogs": ("dogs", "false"), "good with cats": ("cats", "true"),
    "no cats": ("cats", "false"), "housebroken": ("house_trained", "true"), "house trained": ("house_trained", "true"), "house-trained": ("house_trained", "true"),
}

#: The southern border as (longitude, latitude), from west to east.
BORDER = [
    (-141, 60), (-135, 59.5), (-130, 54.4), (-123.3, 49.0), (-95.15, 49.0), (-94.8, 49.35), (-90, 48.05), (-84.8, 46.45), (-83.2, 42.0),
    (-82.4, 42.6), (-80, 42.6), (-79.0, 43.05), (-76.4, 44.1), (-74.7, 45.0), (-71.5, 45.0), (-70.3, 45.9), (-69.2, 47.45), (-67.8, 47.0),
    (-66.9, 44.6), (-66, 43.2), (-52.6, 43.2),
]

#: Weights of the pair score's signals, and where pairs go by score.
WEIGHTS = {"photo": 0.35, "name": 0.2, "description": 0.15, "breed": 0.1, "age": 0.1, "sex": 0.1}
AUTO_MERGE, REVIEW = 0.85, 0.6

EARTH_MILES = 3958.8
METERS_PER_MILE = 1609.344
BLOCK_METERS = 25_000.0

#: Notes on how a pet fits a profile, by rule; for the three compatibility rules by what is known.
NOTES = {
    "apartment": ("good", "Good fit: apartment living"), "space": ("check", "Check with the shelter: space & energy needs"),
    "kids": {"true": ("good", "Good fit: kids at home"), "unknown": ("check", "Ask the shelter: kids at home"), "false": ("check", "Check with the shelter: kids")},
    "dogs": {"true": ("good", "Good fit: your dog"), "unknown": ("check", "Ask the shelter: dog compatibility"), "false": ("check", "Check with the shelter: dogs at home")},
    "cats": {"true": ("good", "Good fit: your cat"), "unknown": ("check", "Ask the shelter: cat compatibility"), "false": ("check", "Check with the shelter: cats at home")},
    "alone": ("check", "Check with the shelter: long days alone"), "home": ("good", "Good fit: someone's usually home"),
    "adventure": ("good", "Good fit: adventure buddy"), "care": ("check", "Check with the shelter: special-care needs"),
}
