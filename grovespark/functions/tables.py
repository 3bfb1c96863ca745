"""Genus and species tables, the inventory's regions, and the merge of species into genera."""

GENERA = ["Pinus", "Picea", "Abies", "Larix", "Pseudotsuga", "Quercus", "Ulmus", "Fagus", "Tilia", "Carpinus", "Acer", "Fraxinus", "Betula", "Corylus", "Crataegus", "Incorrect segmentation", "Others"]
INVENTORY = [
    ("BRZ", "Betula_pendula"), ("BK", "Fagus_sylvatica"), ("DB", "Quercus_species"), ("DB.S", "Quercus_robur"), ("DB.B", "Quercus_petraea"),
    ("DB.C", "Quercus_rubra"), ("GB", "Carpinus_betulus"), ("JS", "Fraxinus_excelsior"), ("KL", "Acer_platanoides"), ("JW", "Acer_pseudoplatanus"),
    ("KL.P", "Acer_campestre"), ("LP", "Tilia_cordata"), ("WZ.S", "Ulmus_laevis"), ("GŁG", "Crataegus_monogyna"), ("LSZ", "Corylus_avellana"),
    ("DG", "Pseudotsuga_menziesii"), ("JD", "Abies_alba"), ("MD", "Larix_decidua"), ("SO", "Pinus_sylvestris"), ("ŚW", "Picea_abies"),
    ("OS", "Populus_tremula"), ("TP", "Populus_alba"), ("TP.C", "Populus_nigra"), ("O_S", "Others"), ("I_S", "Incorrect segmentation"),
]
REGIONS = {"BIAŁYSTOK": "Bialystok", "KATOWICE": "Katowice", "KRAKÓW": "Krakow", "KROSNO": "Krosno", "LUBLIN": "Lublin", "ŁÓDŹ": "Lodz", "OLSZTYN": "Olsztyn", "PIŁA": "Pila", "POZNAŃ": "Poznan", "SZCZECIN": "Szczecin", "SZCZECINEK": "Szczecinek", "TORUŃ": "Torun", "WROCŁAW": "Wroclaw", "ZIELONA GÓRA": "Zielona_Gora", "GDAŃSK": "Gdansk", "RADOM": "Radom", "WARSZAWA": "Warszawa"}
OTHERS_GENUS, BAD_GENUS, OTHERS_SPECIES, BAD_SPECIES = 16, 15, 23, 24

#: Test data: segments and part types stand for species.
CODES = {"AUTOMOBILE": "BRZ", "BUILDING": "SO", "FURNITURE": "DB.S", "HOUSEHOLD": "KL.P", "MACHINERY": "TP"}
MERGE = {"ECONOMY": "Plain", "STANDARD": "Plain", "PROMO": "Special"}
ALLOWED = ["Plain", "Special", "LARGE"]


def genus_of(latin: str) -> int:
    """The genus of a species: its whole name if that is a genus, else what stands before the first underscore, else Others."""
    return next((GENERA.index(n) for n in (latin, latin.split("_")[0]) if n in GENERA), OTHERS_GENUS)


def default_species(genus: str) -> int:
    """The first species of the table whose name begins with the genus and an underscore, else Others."""
    return next((i for i, (_, latin) in enumerate(INVENTORY) if latin.startswith(genus + "_")), OTHERS_SPECIES)
