"""Fixed values of the sign rules: words, patterns, building types, sign types, prices.

Everything here must have these values for results to be right. Patterns are regular expressions that mean the
same in Spark (Java) and in SQL engines with RE2 syntax; they are searched for, upper case is assumed.
"""

from __future__ import annotations

# Room flags: fixed values.
RESTROOM = r"\bTOILET\b|\bRESTROOM\b|\bBATHROOM\b|\bLAVATORY\b|\bSHOWER\b|SHOWER.?LOCKER|\bLOCKER\b|\bMEN'?S\b|\bMENS\b|\bWOMEN'?S\b|\bWOMEN\b|\bMALE\b|\bFEMALE\b|\bGENDER\b|\bUNISEX\b|\bWC\b|\bBOYS\b|\bGIRLS\b|ADA RESTROOM"
STAIR = r"\bSTAIR(?:S|WELL|WAY|CASE|CORE|SHAFT)?\b"
STAIR_LAST_WORD = r".+\bSTAIR\s*$"
STAIR_QUALIFIED = r"^(?:STAIR|EXIT|EMERGENCY|EGRESS)\b"
STAIR_AFTER_OTHER = r"\b(?:MEN'?S|WOMEN'?S|JAN(?:ITOR)?|BREAK|MECH(?:ANICAL)?)\b.+\bSTAIR\b"
ELEVATOR = r"\bELEV(?:ATOR)?\b|\bLIFT\b"
VESTIBULE = r"\bVEST(?:IBULE)?\b|ENTRY VEST|EXIT VEST|AIR LOCK"
CORRIDOR = r"\bCORR(?:IDOR)?\b|\bHALL(?:WAY)?\b|\bHALL\b|\bPASSAGE\b|\bGALLERY\b|\bCIRCULATION\b|\bWALKWAY\b|\bCONCOURSE\b|\bBREEZEWAY\b|\bRAMP\b"
VEHICLE_BAY = r"\bAPPARATUS\b|\bGARAGE\b|\bVEHICLE\b|\bBAY\b|\bDRIVE.?THROUGH\b"
MEP = r"\bMECH(?:ANICAL)?\b|\bELEC(?:TRICAL)?\b|\bIDF\b|\bMDF\b|\bTELECOM\b|\bSERVER\b|\bIT\s*ROOM\b|\bJAN(?:ITOR)?\b|\bSPRINKLER\b|PUMP\s*ROOM|\bUTILITY\b|\bFAN\s*ROOM\b|\bBOILER\b|\bHVAC\b"
ASSEMBLY = r"\bTRAINING\b|\bMEETING\b|\bCONFERENCE\b|\bAUDITORIUM\b|\bCHAPEL\b|\bCOMMUNITY\b|\bEOC\b|\bBANQUET\b|\bDINING\b|\bASSEMBL|\bGYMNASIUM\b|\bGYM\b|\bCAFETERIA\b|\bSANCTUARY\b|\bNAVE\b|\bTHEAT(?:ER|RE)\b|\bBALLROOM\b|\bCOURTROOM\b|\bLECTURE\s*HALL\b|\bMULTIPURPOSE\b|\bFELLOWSHIP\b|\bHEARING\s*ROOM\b|\bCOUNCIL\s*CHAMBER\b|\bARENAF?\b"
VARIABLE_USE = r"\bTRAINING\b|\bEOC\b|\bCOMMUNITY\b|MULTI.?PURPOSE|FLEX\s*ROOM|MULTI\s*USE|\bCONVERTIBLE\b"
PUBLIC_FACING = r"\bLOBBY\b|\bPUBLIC\b|\bRECEPTION\b|\bWAITING\b|\bFRONT\b"
RESIDENTIAL_UNIT = r"^UNIT\b|^APT\b|^SUITE\b|\bUNIT\s+\d"
DOOR_ENTRY = r"^[0-9]+[A-Za-z]?$"
UNIT_DOOR_CODE = r"^UNIT\s+[0-9]+[A-Z]+$"
DORM = r"\bDORM(?:ITORY)?\b|\bBUNK\b|\bSLEEP(?:ING)?\b"
MEZZANINE = r"\bMEZZ(?:ANINE)?\b"
LOBBY_OR_ENTRY = r"\bLOBBY\b|\bENTRY\b|\bENTRANCE\b"
MENS = r"\bMEN'?S\b|\bMALE\b"
WOMENS = r"\bWOMEN'?S\b|\bFEMALE\b"
RESIDENTIAL_COMMON = r"\bLOBBY\b|\bMAIL.?ROOM\b|\bMAILROOM\b|\bLAUNDRY\b|\bFITNESS\b|\bGYM\b|\bGYMNASIUM\b|\bLEASING\b|\bPACKAGE\b|\bCOMMUNITY\b|\bCLUB.?ROOM\b|\bCLUBROOM\b|\bBUSINESS.?CENTER\b|\bPOOL\b|\bCONCIERGE\b|\bRECEPTION\b|\bLOUNGE\b|\bTHEATER\b|\bTHEATRE\b|\bCONFERENCE\b|\bCOURTYARD\b|\bROOFTOP\b|\bBICYCLE\b|\bBIKE\b|\bPARCEL\b"
MULTI_ENTRY = r"\bAPPARATUS\b|\bGYMNASIUM\b|\bAUDITORIUM\b|\bARENA\b|\bSTADIUM\b|\bCAFETERIA\b|\bCHAPEL\b|\bBALLROOM\b|\bTHEAT(?:ER|RE)\b|\bCONVENTION\b|\bBANQUET\b|\bMULTIPURPOSE\b|\bAMPHITHEAT(?:ER|RE)\b|\bLECTURE\s+HALL\b|\bEXHIBITION\b|\bSPORTS\s+COMPLEX\b|\bASSEMBLY\s+HALL\b|\bPERFORMANCE\s+HALL\b|\bCONFERENCE\b"
SCHEDULE_ROW = r"OCCUPANT.?LOAD|LOAD.?TABLE|FIXTURE.?TABLE|DOOR.?SCHEDULE|FINISH.?SCHEDULE|^KEYNOTE|^GENERAL.?NOTE|^NOTE:|^LEGEND|^ABBREVIATION|^DETAIL\s|^SECTION\s[A-Z]|^BC\s|^FEET\s*SCALE$|^INCH\s*SCALE$|^FEET$|^SCALE$|^TEEF|^ELACS|^HCNI"
UNIT_OR_APT = r"^UNIT\b|^APT\b"
SUITE = r"^SUITE\b"
CAPACITY = "assembly|auditorium|cafeteria|gymnasium|gym|theater|theatre|chapel|conference|meeting|ballroom|banquet|lecture|multipurpose|multi-purpose|classroom|training room|community room|community|event space|flex room|activity room|recreation room"
EXIT_CLUSTER = r"\bEXIT\b|\bSTAIR(?:S|WELL|WAY|CASE|CORE|SHAFT)?\b|\bELEV(?:ATOR)?\b|\bLIFT\b|\bLOBBY\b|\bENTRY\b|\bENTRANCE\b"
EDUCATION_ANCHOR = r"\bCORR(?:IDOR)?\b|\bHALL(?:WAY)?\b|\bHALL\b|\bLOBBY\b|\bFOYER\b|\bENTRY\b|\bENTRANCE\b"
GARBLED = r"\d+[Xx]\d+|\d+'-\d|(?i:\bTO\s+[EW]\d)|(?:\.\d+){2,}|\b19[A-J]\b|(?i:\bMB\b.*\d|\d.*\bMB\b)|(?i:\bTB\b.*\d|\d.*\bTB\b)|(?i:\bRY\s+CT\b)|(?i:\bKIT\s+EN\b)|(?i:\bCAF\s+ERIA\b)|(?i:\bAFETER\b)"

# Building types named by rooms, in this order: fixed values.
TYPE_WORDS = [
    ("healthcare", r"\bPATIENT\b|\bNURSE\b|\bEXAM ROOM\b|\bICU\b|\bOPERATING\b|\bER\b|\bEMERGENCY DEPT\b|\bSURGERY\b"),
    ("education", r"\bCLASSROOM\b|\bGYMNASIUM\b|\bGYM\b|\bCAFETERIA\b|\bPRINCIPAL\b|\bLIBRARY\b|\bMEDIA CENTER\b"),
    ("assembly", r"\bNAVE\b|\bSANCTUARY\b|\bALTAR\b|\bPARISH\b|\bNARTHEX\b|\bCHANCEL\b|\bAUDITORIUM\b|\bARENACT\b"),
    ("lab", r"\bCLEAN ROOM\b|\bFUME HOOD\b|BSL-|\bLABORATORY\b|\bLAB\b"),
    ("bank", r"\bVAULT\b|\bTELLER\b|\bSAFE DEPOSIT\b|\bCOUNTING ROOM\b"),
    ("warehouse", r"\bASSEMBLY LINE\b|\bLOADING DOCK\b|\bSHIPPING\b|\bRECEIVING\b|\bWAREHOUSE\b|\bFACTORY\b"),
    ("retail", r"\bMERCHANDISE\b|\bFITTING ROOM\b|\bPOS\b|\bSTOCK ROOM\b|\bRETAIL\b|\bSHOWROOM\b"),
    ("senior_living", r"\bMEMORY CARE\b|\bASSISTED LIVING\b|\bSKILLED NURSING\b|\bRESIDENT ROOM\b"),
    ("government", r"\bCOUNCIL CHAMBER\b|\bCOURT ROOM\b|\bCOURT CLERK\b|\bPOLICE\b|\bFIRE STATION\b|\bAPPARATUS\b"),
]
UNIT_NAMED = r"^UNIT\s+\S|\bUNIT\s+\d"
HOTEL_ROOM, HOTEL_LOBBY, HOTEL_DESK = r"^ROOM\s+\d", r"\bLOBBY\b", r"FRONT DESK|CHECK-IN|\bRECEPTION\b"

# Building type groups: fixed values.
TYPE_GROUPS = {
    "commercial": ("commercial", "office", "retail", "restaurant", "airport", "transit", "warehouse", "industrial", "mixed_use", "mixed"),
    "residential": ("residential", "multifamily", "apartment", "condo", "senior_living", "dormitory", "affordable_housing"),
    "education": ("education", "school", "university", "college", "daycare", "library"),
    "healthcare": ("healthcare", "hospital", "clinic", "medical", "dental", "nursing_home"),
    "government": ("government", "municipal", "federal", "courthouse", "police", "fire_station", "military"),
    "hotel": ("hotel", "motel", "resort", "inn"),
    "assembly": ("assembly", "church", "theater", "theatre", "arena", "stadium", "convention", "museum", "gym_venue"),
    "unknown": ("unknown",),
}
ALIASES = {alias: group for group, names in TYPE_GROUPS.items() for alias in names}

# Traits of building types (unit numbers, policy for service rooms, assembly rules, directory, elevator mode, area of rescue): fixed values.
TRAITS = {
    "residential": (True, "all", False, False, "per_level", False),
    "commercial": (False, "occupied_only", True, True, "per_building", False),
    "school": (False, "minimal", True, False, "per_building", False),
    "hospital": (False, "minimal", True, False, "per_level", False),
    "hotel": (True, "all", True, False, "per_level", False),
    "retail": (False, "all", True, False, "per_building", False),
    "warehouse": (False, "all", False, False, "per_building", False),
    "lab": (False, "occupied_only", False, True, "per_building", False),
    "bank": (False, "occupied_only", False, True, "per_building", False),
    "government": (False, "occupied_only", True, True, "per_building", True),
    "church": (False, "occupied_only", True, False, "per_building", True),
    "senior_living": (True, "all", True, False, "per_level", False),
    "mixed": (False, "occupied_only", True, True, "per_building", False),
    "education": (False, "all", True, False, "per_building", False),
    "healthcare": (False, "all", True, False, "per_level", False),
    "assembly": (False, "occupied_only", True, False, "per_building", True),
    "unknown": (False, "occupied_only", True, True, "per_building", False),
}
UNIT_SIGN_TYPES = ("residential", "multifamily", "hotel", "senior_living", "dormitory")
RESIDENTIAL_TYPES = ("residential", "multifamily", "senior_living", "dormitory")
EDUCATION_TYPES = ("education", "school", "university", "college", "daycare", "library")
EVAC_MAPS_PER_FLOOR = {"education": 2, "healthcare": 4, "commercial": 2, "government": 2, "hotel": 1, "residential": 1, "assembly": 2, "unknown": 2}
EXTERIOR_EXITS = {"education": 4, "healthcare": 4, "commercial": 4, "government": 4, "hotel": 4, "residential": 2, "assembly": 6, "unknown": 4}
STAIR_NUMBER = {
    "education": r"^S[A-H]\d{2,3}$",
    "healthcare": r"^S[A-E]\d{2}$|^ST\d{2,3}$",
    "commercial": r"^S\d{1,2}$|^STAIR-?\d+$",
    "government": r"^S\d{1,2}$|^STAIR[A-Z]$",
    "hotel": r"^S\d{1,2}$|^STAIR-?\d+$",
    "residential": r"^S\d{1,2}$|^STAIR-?\d+$",
    "assembly": r"^S\d{1,2}$|^[A-Z]{1,2}-S\d+$",
}
_EDUCATION_NUMBER = r"(?i)^[WE]C?\d{3}[A-Z]?$|^S[ABCD]\d{2}$|^EV\d{2}$"
VALID_NUMBER = {
    "education": _EDUCATION_NUMBER,
    "school": _EDUCATION_NUMBER,
    "healthcare": r"^\d{3,4}[A-Z]?$|^[A-Za-z]{1,3}\d{3}$",
    "hospital": r"^\d{3,4}[A-Z]?$|^[A-Za-z]{1,3}\d{3}$",
    "office": r"^\d{3,4}[A-Z]?$|^[A-Za-z]\d{3}$",
    "commercial": r"^\d{3,4}[A-Z]?$|^[A-Za-z]\d{3}$",
    "government": r"^\d{3,4}[A-Z]?$|^[A-Za-z]-?\d{3}$",
    "hotel": r"^\d{3,4}[A-Z]?$",
    "residential": r"^\d{3,4}[A-Z]?$",
    "assembly": r"^\d{3,4}[A-Z]?$|^[A-Za-z]{1,2}-?\d{2,3}$",
}
ANY_NUMBER = r"^.{2,10}$"

# Sign types with braille: fixed values.
ADA_REQUIRED = ("Room ID", "Room ID w/insert", "Room ID w/Insert", "Restroom", "Restroom(Women)", "Restroom(Men)", "Restroom(Unisex)", "Stair(Corridor)", "Stair(Landing)", "Stair (Corridor)", "Stair (Landing)", "Exit(Tactile)", "Area of Rescue", "Elevator", "Elevator Mach Rm", "Accessible Entrance", "Unit ID", "In Case of Fire", "Boys", "Girls", "Men", "Women", "Unisex Restroom", "Family Restroom", "Accessible Room", "Patient Room ID", "Courtroom ID")
LARGE_SIGNS = ("Evacuation Map", "Office Directory", "Building ID")
AUTO_FROM, HIGH_CONFIDENCE = 0.7, 0.75

# List prices (material rate, finishing rate, width, height, least price): fixed values.
LIST_PRICES = {
    "room_id": (0.53, 0.73, 6, 6, 20),
    "room_identification": (0.53, 0.73, 6, 6, 20),
    "restroom": (0.53, 0.73, 6, 8, 20),
    "exit": (0.50, 0.73, 6, 8, 20),
    "exit_sign": (0.50, 0.73, 6, 8, 20),
    "exit_tactile": (0.50, 0.73, 6, 8, 20),
    "stair_corridor": (0.53, 0.73, 6, 8, 20),
    "stair_landing": (0.53, 0.73, 6, 12, 20),
    "elevator": (0.53, 0.73, 4, 6, 20),
    "elevator_mach_rm": (0.53, 0.73, 6, 6, 20),
    "elevator_machine_room": (0.53, 0.73, 6, 6, 20),
    "unit_id": (0.53, 0.73, 4, 6, 20),
    "max_occupancy": (0.50, 0.39, 6, 8, 20),
    "occupancy": (0.50, 0.39, 6, 8, 20),
    "accessible_entrance": (0.50, 0.73, 6, 8, 20),
    "accessible": (0.50, 0.73, 6, 8, 20),
}
OTHER_PRICE = (0.53, 0.73, 6, 8, 20)
FLAT_PRICES = {"evacuation_map": 45.0}
INSTALL_PRICE = 18.00
#: Installation of types that cost otherwise, unless a tenant has a list of its own.
INSTALL_OVERRIDES = {"Elevator": 25.00, "Evacuation Map": 25.00}
#: US dollars for a million input and output tokens.
TOKEN_PRICES = (1.25, 5.00)

# Estimation prices by words in the type, in this order: fixed values.
ESTIMATES = {
    "Typical Toilet Room Sign": 185.0,
    "Room Sign with Insert": 195.0,
    "Emergency Exit": 145.0,
    "Fire Extinguisher": 95.0,
    "Room Sign with No Storage": 185.0,
    "Occupancy Sign": 95.0,
    '24" Letter Signage': 450.0,
    "Typical Room Sign": 165.0,
    "Egress Map": 285.0,
    "Egress Stair Sign at Corridor": 165.0,
    "Typical Stair Sign at Landing": 195.0,
    "Sign at Elevator": 165.0,
    "Sign at Unit": 95.0,
    "Elevator Machine Room Sign": 145.0,
    "Sign at Corridor": 245.0,
    "Elevator Control Room Location Sign": 145.0,
}
OTHER_ESTIMATE = 150.0

# Room numbers that education buildings allow: fixed values.
ALLOWLIST_TYPES = ("education", "school")
ALLOWED_NUMBER = r"(?i)^(?:W|E)\d{3}[A-Z]?$|^(?:WC|EC)\d{3}[A-Z]?$|^(?:SA|SB|SC|SD)\d{2}$|^EV\d{2}$"

# Profiles of building types (evacuation maps of a floor, area of rescue, stairs by default): fixed values.
PROFILES = {
    "commercial": (4, False, 2),
    "healthcare": (6, True, 2),
    "education": (4, False, 2),
    "residential": (2, False, 2),
    "hotel": (4, False, 2),
    "retail": (4, False, 2),
    "assembly": (6, True, 2),
    "warehouse": (2, False, 1),
    "unknown": (4, False, 2),
}
EGRESS_EXITS = {"education": 4, "healthcare": 4, "commercial": 2, "government": 3, "hotel": 2, "residential": 2, "assembly": 4, "unknown": 2}
EGRESS_STAIR_NUMBER = r"^S[A-F]\d{1,2}[A-Z]?$|^S\d{1,2}[A-Z]?$|^STAIR[-\s]?[A-Z0-9]"
EGRESS_STAIR_NAME = r"STAIR(?:WAY|WELL)?(?:\s|$)|^(?:S1|S2|SA|SB)(?: |$)"
DECISION_POINT = "^(?:CORRIDOR|HALL|HALLWAY|PASSAGE|GALLERY|CIRCULATION|WALKWAY|BREEZEWAY)"
EGRESS_NUMBER = "^(?:STAIR-|EXIT-STAIR-|EXIT-EXT-|EVAC-L|AOR-STAIR-)"

# Spreadsheet columns by their names in lower case: fixed values.
NUMBER_COLUMNS = ("room #", "room#", "room number", "door #", "door#", "door number", "unit #", "unit#", "unit number", "space #", "space#", "rm #", "rm#")
NAME_COLUMNS = ("room name", "room", "text on sign", "sign text", "space name", "space", "description", "name")
META_COLUMNS = (*NUMBER_COLUMNS, *NAME_COLUMNS, "bldg", "building", "level", "floor", "suite", "notes", "note", "project", "address")
NOT_SIGN_COLUMNS = ("level", "floor", "bldg", "building", "suite", "notes", "note", "qty", "quantity", "total", "comments", "project", "address")
SECTION_ROW = r"(?i)ground|floor|level|basement|mezzanine|roof|\d+(?:st|nd|rd|th)"
SIGN_CODE = r"\s+[A-Z]{1,3}\d+[A-Z]?\s*$"
CANONICAL = ("Room ID", "Room ID w/insert", "Restroom", "Restroom(Women)", "Restroom(Men)", "Restroom(Unisex)", "Exit", "Exit(Tactile)", "Stair(Corridor)", "Stair(Landing)", "Elevator", "Elevator Mach Rm", "Accessible Entrance", "Accessible Parking", "Evacuation Map", "Office Directory", "Building ID", "Directional", "Unit ID", "Max Occupancy", "Area of Rescue")

# Abbreviations in room names: fixed values.
SYNONYMS = {"VEST": "VESTIBULE", "CORR": "CORRIDOR", "HALL": "HALLWAY", "STOR": "STORAGE", "MECH": "MECHANICAL", "ELEC": "ELECTRICAL", "CONF": "CONFERENCE", "TLTL": "TOILET", "TLT": "TOILET", "TOIL": "TOILET", "REST": "RESTROOM", "BLDG": "BUILDING", "RR": "RESTROOM", "MRR": "MENS RESTROOM", "WRR": "WOMENS RESTROOM", "EMERG": "EMERGENCY", "INTERROG": "INTERROGATION"}

# Sheets that hold no plan view: fixed values.
ADMIN_SHEETS = ("A-001", "A001", "A-002", "A002", "A-003", "A003")
OTHER_DISCIPLINES = "^(?:S-|M-|E-|P-|C-|FP-)"
RESTROOM_TITLE = r"\b(?:TOILET|RESTROOM|LAVATORY)\b|\bRR\b"
NO_PLAN_TITLES = "ELEVATION|SECTION|EGRESS|ACCESSORY LEGEND|LIGHT FIXTURE SCHEDULE|BATHROOM FINISH|DRAWING INDEX|SYMBOL LEGEND|ABBREVIATIONS|SPECIFICATIONS|CODE ANALYSIS|LIFE SAFETY NOTES|PLUMBING FIXTURE SCHEDULE|LIGHTING SCHEDULE|LIGHTING PLAN|ELECTRICAL SCHEDULE|PLUMBING SCHEDULE|MECHANICAL SCHEDULE|REFLECTED CEILING|FINISH PLAN|FURNITURE PLAN|POWER PLAN|DATA PLAN"
PLAN_ONLY_TITLES = "GENERAL NOTES|DOOR SCHEDULE|WINDOW SCHEDULE"
#: Words in a file's name, upper case, and the level they tell: fixed values.
FILE_FLOORS = [
    (("1ST", "FIRST"), "LEVEL 1"),
    (("2ND", "SECOND"), "LEVEL 2"),
    (("3RD", "THIRD"), "LEVEL 3"),
    (("4TH", "FOURTH"), "LEVEL 4"),
    (("5TH", "FIFTH"), "LEVEL 5"),
    (("6TH", "SIXTH"), "LEVEL 6"),
    (("BASEMENT", "B1"), "LEVEL B1"),
    (("GROUND",), "LEVEL 1"),
]
#: Patterns of a floor label, lower case, and the level they tell: fixed values.
LABEL_FLOORS = [
    (r"first\s+floor|1st\s+floor", "LEVEL 1"),
    (r"second\s+floor|2nd\s+floor", "LEVEL 2"),
    (r"third\s+floor|3rd\s+floor", "LEVEL 3"),
    (r"fourth\s+floor|4th\s+floor", "LEVEL 4"),
    (r"fifth\s+floor|5th\s+floor", "LEVEL 5"),
    (r"basement|b1", "LEVEL B1"),
]
# Floors in sheet titles, in this order: fixed values.
TITLE_FLOORS = [
    (r"first\s+floor|floor\s*[-\s]?1|level\s*[-\s]?1|ground\s+floor", "LEVEL 1"),
    (r"second\s+floor|floor\s*[-\s]?2|level\s*[-\s]?2", "LEVEL 2"),
    (r"third\s+floor|floor\s*[-\s]?3|level\s*[-\s]?3", "LEVEL 3"),
    (r"fourth\s+floor|floor\s*[-\s]?4|level\s*[-\s]?4", "LEVEL 4"),
    (r"fifth\s+floor|floor\s*[-\s]?5|level\s*[-\s]?5", "LEVEL 5"),
    (r"basement|lower\s+level|\blevel\s*[-\s]?b\b", "LEVEL B1"),
    ("mezzanine", "MEZZANINE"),
    (r"\broof\b", "ROOF"),
]

# Names that are notes, materials or table rows, not rooms: fixed values.
JUNK_WORDS = ("PTD", "HM", "VIF", "GWB", "CMU", "ACT", "MTL", "STL", "GALV", "FL-N", "QUARTZ", "RUBBER", "SEAMLESS", "PAINTED", "EXISTING", "FLOORING", "CEILING", "LEGEND", "REMOVED", "DEMOLISHED", "NEW", "REINSTALL", "INSTALL", "PROVIDE", "COORDINATE")
TABLE_WORDS = ("FLOOR", "BASE", "WALLS", "CEILING", "COMMENTS", "LEGEND", "FLOORING", "RUBBER", "SEAMLESS", "PAINTED", "EXISTING", "FINISH", "SCHEDULE", "NUMBER", "NAME")
NOTE_PHRASES = r"FIELD MEASURE|V\.I\.F\.|SEE DETAIL|COORDINATE WITH|SEE DRAWING|NEW WORK|AREA OF WORK|TEMPORARY|REINSTALL|DEMOLISH"
SHORT_WORDS = ("WC", "RR", "IT", "MR", "DR", "AV", "HR", "PR", "SR", "NO", "OF", "BY")
EXEMPT_UNIT = r"^(?:UNIT|APT|SUITE|APARTMENT|FLAT)\s+[A-Z0-9]{1,4}$"
NOT_A_NAME = r"^[A-Z]{1,2}\d{2,}\.\d+$|^[A-Z]{1,3}\s+\d+['\"’‘]|^[\d\s\-'\"`’‘“”/]+$|^[^A-Z0-9]|\d+['\"’‘][-–]\d+|\b\d+\s*X\s*\d+\b|\bTO\s+[EW][A-Z0-9]"
JUNK_ROW = r"OCCUPANT.?LOAD|LOAD.?TABLE|FIXTURE.?TABLE|DOOR.?SCHEDULE|FINISH.?SCHEDULE|PLUMBING.?SCHEDULE|HARDWARE.?SET|^KEYNOTE|^GENERAL.?NOTE|^NOTE:|^LEGEND|^ABBREVIATION|^SYMBOL|^FEET\s*SCALE$|^INCH\s*SCALE$|^FEET$|^SCALE$|^TEEF|^ELACS|^HCNI"
SHORT_NUMBER = r"^(?:\d{1,2}|[A-Z]{1,2}\d{1,2})$"
ANNOTATION = r"\d+X\d+|\d+'-\d|^[\s.\-'\"]+$|\bTO\s+[EW]\d"
PLAIN_CORRIDOR = r"^(?:CORRIDOR|HALLWAY|HALL|CIRCULATION|COMMON\s+CORRIDOR|PUBLIC\s+CORRIDOR)$"
EGRESS_NAMES = "STAIR|EXIT|ELEV|LOBBY|VESTIBULE|MECHANICAL|ELECTRICAL|FIRE"
RESTROOM_SCOPE = r"\b(?:TOILET|RESTROOM|BATHROOM|WC|UNISEX|STAFF\s*RR|BOYS|GIRLS|MEN|WOMEN|GENDER|LAVATORY|ACCESSIBLE)\b"
GENERAL_TITLE = r"\bFLOOR\s+PLAN\b|\bROOM\s+SCHEDULE\b|\bFINISH\s+SCHEDULE\b"
# Sign types that a schedule's type definitions suppress by not naming them: fixed values.
SUPPRESSED_UNLESS = [(("Exit", "Exit(Tactile)"), r"\bEXIT\b"), (("Evacuation Map",), r"EVAC(?:UATION)?|EMERGENCY.?\s*MAP"), (("Office Directory", "Building ID"), r"\bDIRECTORY\b")]

# Sign codes of schedules: fixed values.
SCHEDULE_CODES = {
    "BB2A": "Room ID",
    "BB2B": "Room ID w/insert",
    "BB2C": "Conference",
    "BB2D": "Occupancy(MaxCapacity)",
    "BB2E": "Egress(Emergency)",
    "BB3": "Stair(Landing)",
    "BB4": "Exit(Tactile)",
    "BB5": "Entry(Building)",
    "BB7A": "Restroom(Men)",
    "BB7B": "Restroom(Women)",
    "SS1A": "Stair ID",
    "AA1": "Directory(Building)",
    "AA2": "Directory(Floor)",
    "AA3": "Directory(Floor)",
    "DD1": "Regulatory(NoSmoking)",
    "LED": "LED(Programmable)",
    "BB6": "Evac Map",
}
TYPE_CODE = r"(?i)^Type\s+[A-Z0-9][A-Z0-9.]*$"
DEFINITION_CODE = r"(?i)^[A-Z][0-9]?[A-Z]?[0-9]?$"

# Columns of schedule tables: fixed values.
ROOM_COLUMNS = ("ROOM", "ROOM #", "ROOM NO", "ROOM NUMBER", "ROOM NAME")
COUNT_TYPE_COLUMNS = ("SIGNAGE TYPE", "SIGN TYPE", "TYPE", "DESCRIPTION")
COUNT_COLUMNS = ("COUNT", "QTY", "QUANTITY", "TOTAL")
MARK_COLUMNS = ("TYPE MARK", "MARK", "TYPE CODE", "CODE")
LOOSE_COLUMNS = ("ROOM", "ROOM #", "ROOM NO", "SIGN TYPE", "TYPE", "QTY", "QUANTITY", "LOCATION", "SIGN ID", "MESSAGE", "SIZE")
SIGN_TABLE_COLUMNS = ("ROOM #", "SIGN TYPE", "SIGN ID", "MESSAGE", "LOCATION", "QTY")
FINISH_CODE = r"(?i)\s+(?:TILE-\d+|LVT-\d+|VCT-\d+|EPX|SC|EXISTING|MATCH\s+EX|GWB|ACT-\d+|P-\d+|PT-\d+|VCB-\d+|CTB-\d+|ECB|NC)\b.*$"
EXPORT_STRUCTURE = ("", "subtotal", "total", "grand total", "installation")

# Words of sheet titles by category, in the order in which they are tried: fixed values.
SHEET_DISCIPLINE = r"^(?:E|M|P|S|C|FP|MP|SP|LS)[-.\s\d]"
SHEET_ROOM_SCHEDULE = ("FINISH SCHEDULE", "ROOM SCHEDULE", "ROOM FINISH SCHEDULE", "ROOM FINISH PLAN", "FINISH & SCHEDULE", "SCHEDULES")
SHEET_SKIP = (
    "ELECTRICAL", "MECHANICAL", "PLUMBING", "STRUCTURAL", "REFLECTED CEILING", "LIGHTING PLAN", "POWER PLAN", "DATA PLAN", "FIRE PROTECTION", "SPRINKLER", "CIVIL",
    "MATERIAL SCHEDULE", "FURNITURE SCHEDULE", "EQUIPMENT SCHEDULE", "FIXTURE SCHEDULE", "LIGHTING SCHEDULE", "HARDWARE SCHEDULE", "INTERIOR FINISH", "FINISH LEGEND",
    "MATERIAL LEGEND", "KEYNOTE LEGEND", "KEYNOTE SCHEDULE", "DESIGN DEVELOPMENT", "PERMIT DRAWING", "CODE ANALYSIS", "ACCESSIBILITY ANALYSIS", "LIFE SAFETY PLAN",
    "AREA CALCULATION", "ZONING ANALYSIS",
)
SHEET_SPECIALTY = (
    "SIGN DETAIL", "SIGNAGE DETAIL", "SIGNING DETAIL", "EXTERIOR SIGNAGE", "SITE SIGN", "EXTERIOR SIGN", "WALLCOVERING", "WALL COVERING", "WALL GRAPHIC", "MURAL",
    "INTERPRETIVE", "LEED SIGN", "WAYFINDING DETAIL", "DIMENSIONAL LETTER", "CHANNEL LETTER", "BLADE SIGN", "ENLARGED SIGNAGE", "TRAILHEAD", "KIOSK", "DONOR",
    "RECOGNITION WALL", "MONUMENT SIGN", "PLAQUE SCHEDULE", "PLAQUE DETAIL", "MOUNTING DETAIL", "MOUNTING HEIGHT", "SIGN PANEL", "SIGN SUBSTRATE", "SIGN FACE",
    "SIGN FRAME", "SIGN ASSEMBLY", "WAYFINDING PLAN", "WAYFINDING LAYOUT", "WAYFINDING SYSTEM", "WAYFINDING SIGNAGE", "WAYFINDING", "PARKING SIGNAGE",
    "GARAGE SIGNAGE", "DIRECTIONAL SIGNAGE", "SIGN LOCATION PLAN", "SIGNAGE LOCATION", "SIGNAGE PLAN",
)
SHEET_SIGN_DOCS = ("SIGN SCHEDULE", "SIGN SPEC", "SIGNAGE SCHEDULE", "SIGN TYPE", "SIGN LEGEND", "SIGN NOTES", "SIGN CRITERIA", "SIGN MATRIX", "INTERIOR SIGNAGE SCHEDULE", "DIVISION 10", "DOOR SCHEDULE")
SHEET_EXTERIOR = ("SITE PLAN", "EXTERIOR ELEVATION", "BUILDING ELEVATION", "FACADE", "LANDSCAPE", "HARDSCAPE", "MONUMENT", "PYLON", "PARKING PLAN", "SITE SIGNAGE", "EXTERIOR PERSPECTIVE", "RENDERING")
SHEET_PLAN = ("FLOOR PLAN", "LEVEL", "GROUND FLOOR", "BASEMENT", "MEZZANINE", "PENTHOUSE", "ENLARGED PLAN", "ENLARGED FLOOR", "SIGNAGE PLAN", "SIGN PLAN")
SIGN_NOTES_TITLE = r"\b(?:SIGNAGE|SIGN\s+SCHEDULE|SIGN\s+NOTES?|SIGN\s+TYPES?|SIGN\s+LEGEND|SIGN\s+CRITERIA|SIGN\s+SPEC|DIVISION\s*10|GENERAL\s+NOTES)\b"
RESTROOM_RESCUE = r"\b(?:TOILET|RESTROOM|BATHROOM|LAVATORY|ENLARGED|RCP|RR)\b"
SLOT_CATEGORY = {"floor_plan": "interior", "room_schedule": "room_schedule", "sign_schedule": "sign_docs"}

# Type definitions and the rooms they mean: fixed values.
DEF_RESTROOM = r"\b(?:TOILET|RESTROOM|RR|LAVATORY|WC|BATHROOM|POWDER\s*ROOM)\b"
DEF_GIRLS = r"\b(?:GIRLS?|WOMEN|FEMALE)\b"
DEF_BOYS = r"\b(?:BOYS?|MEN|MALE)\b"
DEF_UNISEX = r"\b(?:UNISEX|GENDER[\s-]*NEUTRAL|FAMILY|SINGLE[\s-]*USER|SINGLE[\s-]*OCC|SINGLE[\s-]*STALL|ACCESSIBLE\s+TOILET)\b"
DEF_ROOM = r"\b(?:ROOM\s*(?:SIGN|NAME|ID)|OCCUPANCY|CONFERENCE|ROOM\s*IDENTIFICATION)\b"
DEF_NOT_ROOM = r"\b(?:STAIR|ELEVATOR|LIFT|EXIT|ENTRANCE)\b"
DEF_ENTRANCE = r"\b(?:ENTRANCE|ENTRY|ACCESSIBLE\s+ENTRANCE|BUILDING\s*(?:ID|ENTRANCE|ENTRY))\b"
DEF_ENTRANCE_ROOM = r"\b(?:ENTRANCE|ENTRY|LOBBY|FOYER|RECEPTION|MAIN\s+ENTRY)\b"

# Sign scope filters: fixed values.
NOT_RESTROOM_ROOMS = r"\b(?:CLASSROOM|OFFICE|STORAGE|CORRIDOR|LOBBY|GYM|CAFETERIA|LIBRARY)\b"
NO_EVAC_ROOMS = r"\bPROJECT\s*AREA\b|\bALCOVE\b|\bPASSAGE\b|\bCLOSET\b|\bSTORAGE\b"
EGRESS_RULES = ("R9", "R11", "R13")
UNIT_RULE = "R16"
EGRESS_SIGNS = ("Exit", "Stair", "Stair (Corridor)", "Stair (Landing)", "Stair (Corridor)/(Landing)", "Evacuation Map", "Area of Rescue", "Directional", "Exit Sign", "Fire Exit", "Emergency Exit", "Egress Door")
SPECIALTY_EXAMPLE = ("stair", "wayfinding", "exit", "elevator", "other")
RESTROOM_SCOPE_DROPS = ("Room ID", "Unit/Room #", "Exit", "Exit(Tactile)", "Regulatory(NoSmoking)", "Evacuation Map", "Stair", "Stair(Landing)", "Stair(Egress)", "Elevator", "Elevator(Braille)", "Directory")

# A line of a drawing index around the first sheet number in it: fixed value.
INDEX_LINE = r"^(.*?)\b([A-Z]{1,3}-?\d{1,4}(?:\.\d{1,3})?[A-Z]?|\d{1,2}\.\d{1,2}\.\d{1,4})\b(.*)$"

# Words of sheet titles by type, lower case: fixed values.
TITLE_SIGN_DETAILS = ("sign detail", "signage detail", "sign typ", "signage typ")
TITLE_SIGN_SCHEDULE = ("sign schedule", "signage schedule", "plaque schedule", "sign legend", "signage legend", "room identification", "sign notes", "signage notes", "sign criteria", "sign spec")
TITLE_EGRESS = ("egress", "life safety", "means of egress", "evacuation")
TITLE_NEVER_PLAN = ("notes", "symbols", "schedule", "specification", "cover sheet", "cover page", "index of", "sheet index", "drawing index", "elevation", "section", "detail")
TITLE_OTHER_PLAN = ("plumbing", "mechanical", "electrical", "hvac", "structural", "civil", "landscape", "demolition", "reflected ceiling", "foundation", "framing", "site plan", "roof plan", "legends", "plan notes", "finish schedule", "parking", "garage", "drain", "basement podium")
TITLE_PLAN = ("floor plan", "floorplan", "construction plan", "first floor", "second floor", "third floor", "level 1", "level 2", "level 3", "level 4", "level 5", "basement plan", "ground floor plan", "partial plan", "overall plan", "signage plan", "sign plan", "partial signage plan", "overall signage plan", "plan - level", "plan - area", "interior plan", "interior signage")
NUMBER_SKIPPED = r"^(?:[pm][-012]|e[-012]|s[-0123]|c[-01]|l[-01]|fd-|fp-|d[-012]|t[-01]|g[-01]|nr-|n-)"

# Words that order levels in a legend, and descriptions that rename the sign of a room: fixed values.
LEGEND_LEVELS = ["ground", "l1", "1", "first", "1st", "l2", "2", "second", "2nd", "l3", "3", "third", "3rd", "l4", "4", "fourth", "4th"]
ROOM_ID_DESCRIPTION = r"\broom[\s-]?id\b|\broom[\s-]?identification\b|\broom[\s-]?number\b"

# Words of a page: numbers of rooms, years, words that are no names, addresses, finish codes, sign codes: fixed values.
ROOM_NUMBER = r"^(?:\d{3}[A-Z]?|1[0-4]\d{2}[A-Z]?(?:\.\d)?|2[0-4]\d{2}[A-Z]?(?:\.\d)?|[A-Z]{1,2}P?\d?-\d{3}[A-Z]?|[A-Z]\d{3}[A-Z]?)$"
YEAR = r"^(?:19|20)\d{2}$"
IGNORED_WORDS = ["THE", "AND", "OR", "OF", "A", "AN", "IN", "AT", "BY", "FOR", "N", "S", "E", "W", "NE", "NW", "SE", "SW", "FT", "SF", "SQ", "FF", "EQ", "TYP", "SIM", "REF"]
IGNORED_UNITS = ["FT²", "M²"]
RESTROOM_LABEL = r"\b(?:TOILET|RESTROOM|RR|BATHROOM|LAVATORY|WC|UNISEX|STAFF|NURSES|CUSTODIAN|PRINCIPALS?)\b"
ADDRESS = r",|\b(?:AVE|BLVD|ST\b|RD\b|DR\b|MA\b|NY\b|CA\b|COPYRIGHT|DRAWING|PROJECT|JACOBS|CORPS)\b"
TAG_ADDRESS = r",|\b(?:AVE|BLVD|ST\b|RD\b|DR\b|MA\b|NY\b|CA\b|COPYRIGHT|DRAWING|PROJECT)\b"
FINISH_CODES = r"^(?:(?:[A-Z]{1,3}-?\d\S*|\d+)(?:\s+|$))+$"
LEGEND_CODE = r"^(?:MB|TB|CB|SA|SB|SC|SD|19[A-Z]|\d+[AB]?)$"
NUMBER_OF_UNIT = r"^\d{3}[A-Z]?$"
