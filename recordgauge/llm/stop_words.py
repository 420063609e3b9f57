"""Frequent function words of four languages."""

# The commonest function words.
ENGLISH = (
    "the of and to in is that for it as was with be by on not he this are or his from at which "
    "but have an had they you were their all we can has been if will who so no a I"
).split()
GERMAN = (
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "werden aus er hat dass sie nach wird bei um am sind noch wie einem einer einen"
).split()
FRENCH = (
    "le la les de des et à un une du en que qui est pour dans ce il au aux sur se ne pas plus par "
    "je avec son sa ses on mais nous vous ou"
).split()
SPANISH = (
    "el la los las de del que y en un una por con no para su al lo como más pero sus se es o este "
    "esta sí porque cuando muy sin sobre ser"
).split()

STOP_WORDS = tuple(sorted({*ENGLISH, *GERMAN, *FRENCH, *SPANISH}))
