"""Common function words of four languages (general knowledge, no corpus)."""

STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple(
        "the of and to in a is that for it as was with be by on not he are this or his from at which but have an had they you were their one all we can has there been if more when will would who so no she her them its than then into only some could these two may other do any my now such like our over me also after first".split()
    ),
    "de": tuple(
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ich du wir".split()
    ),
    "fr": tuple(
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on sa leur aux ces si été être cette elle deux même tout ont fait entre sans je tu vous ses".split()
    ),
    "es": tuple(
        "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros es son ha".split()
    ),
}

ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words)
