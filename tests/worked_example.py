"""The worked example of FIXTURES.md written as CSV workbook sheets."""

from __future__ import annotations

import csv
import os

STATE = [
    ["Site", "num_bat", "nom_bat", "Clos/couvert", "securite", "fonctionnement", "etat_energie", "confort"],
    ["La Gaillarde", "0010", "Bat 10", "ok", "ok", "ok", "Bon", "oui"],
    ["La Gaillarde", "0020", "Bat 20", "ok", "ok", "ok", "Moyen", "oui"],
    ["La Gaillarde", "0030", "Bat 30", "ok", "ok", "ok", "Mauvais", "oui"],
    ["La Gaillarde", "0290", "Bat 290", "ok", "ok", "ok", "ND", "oui"],
    ["La Gaillarde", "0310", "Bat 310", "ok", "ok", "ok", "Bon", "oui"],
]

ROOM_HEADER = [
    "Site", "Bâtiment", "Local", "Nom usuel", "Libellé", "Référence", "Surface sol", "Unité",
    "Tiers accueillis", "Occupants", "Nombre unités", "Surface ajustée", "Typologie", "Remarque", "A SUPPRIMER",
]


def room(site, bat, local, sol, unite, occupants, ajus, flag):
    return [site, bat, local, "", "", "", sol, unite, "", occupants, "", ajus, "", "", flag]


ROOMS = [
    ROOM_HEADER,
    room("La Gaillarde", "0010", "L1", "100", "AGAP", "Dupont, Martin", "80", "NON"),
    room("La Gaillarde", "0010", "L2", "50", "LEPSE", "Durand et Petit / Roy", "40", "NON"),
    room("La Gaillarde", "0010", "L3", "30", "AGAP/LEPSE", "Salle commune", "20", "NON"),
    room("La Gaillarde", "0010", "L4", "20", "IA", "X", "10", "NON"),
    room("La Gaillarde", "0010", "L5", "10", "AGAP", "Y", "10", "OUI"),
    room("La Gaillarde", "0010", "L6", "40", "lepse", "Pierre-Yves", "30", "NON"),
    room("La Gaillarde", "0020", "L1", "60", "agap", "4 personnes", "60", "NON"),
    room("La Gaillarde", "0020", "L2", "40", "SDAR Mutualisé", "", "", "NON"),
    room("La Gaillarde", "0030", "L1", "25", "LEPSE/IPSiM", "Locaux, techniques", "25", "NON"),
    room("La Gaillarde", "0290", "L1", "0", "MISTEA", "A - B", "0", "NON"),
    room("Lavalette", "0400", "L1", "70", "AGAP", "Z", "70", "NON"),
    room("La Gaillarde", "0310", "L1", "15", "", "Q", "15", "NON"),
    room("La Gaillarde", "0010", "L9", "5", "AGAP", "W", "5", ""),
]

STAFF_HEADER = ["Unité", "Nom", "Prénom", "Statut", "Employeur", "Equipe", "Bureau", "Bat", "Note1", "Note2"]


def staff(unite, bat):
    return [unite, "n", "p", "s", "e", "q", "b", bat, "x", "y"]


STAFF = [
    STAFF_HEADER,
    staff("AGAP", "B0010"),
    staff("AGAP", "B0010"),
    staff("LEPSE", "B0010"),
    staff("Associé BAP", "B0010"),
    staff("AGAP", "B0020"),
    staff("MISTEA", "B0290"),
    staff("LEPSE/IPSIM", "B0030"),
]

CONSO_HEADER = [
    "Bâtiment", "Conso 2022 (kWh)", "Conso 2023 (kWh)", "Conso 2024 (kWh)",
    "Différence 2023 et 2024", "Evol 2023/2024 en %", "Commentaire",
]


def sheet(rows):
    out = [CONSO_HEADER]
    for label, a, b, c in rows:
        out.append([label, a, b, c, "", "", "relevé"])
    return out


CONSO = {
    "elec": sheet([
        ("MTP-0010 restauration", "100", "110", "120"),
        ("MTP-0010 hors restauration", "900", "ND", "1080"),
        ("MTP-0020", "500", "600", "700"),
        ("MTP-irag", "10", "20", "30"),
        ("MTP-0290", "50", "60", "70"),
    ]),
    "gaz": sheet([("MTP-0010", "190", "195", "200"), ("MTP-0030", "80", "90", "ND")]),
    "eau": sheet([
        ("MTP-0010 a", "9", "9", "10"),
        ("MTP-0010 b", "19", "19", "20"),
        ("MTP-0020", "6", "6", "7"),
        ("MTP-sage arrosage", "5", "5", "5"),
    ]),
    "reseau": sheet([("MTP-0020", "280", "290", "300"), ("MTP-0310", "38", "39", "40")]),
    "fod": sheet([("Cuve A", "10", "10", "11"), ("Cuve B", "20", "21", "22"), ("Cuve C", "30", "32", "33")]),
}


def _write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def write_workbooks(folder: str) -> dict:
    """Write every sheet as a CSV file; return the paths."""
    paths = {"state": os.path.join(folder, "etat.csv"), "rooms": os.path.join(folder, "occupation.csv"),
             "staff": os.path.join(folder, "effectifs.csv")}
    _write(paths["state"], STATE)
    _write(paths["rooms"], ROOMS)
    _write(paths["staff"], STAFF)
    conso = {}
    for r, rows in CONSO.items():
        conso[r] = os.path.join(folder, f"conso_{r}.csv")
        _write(conso[r], rows)
    paths["conso"] = conso
    return paths
