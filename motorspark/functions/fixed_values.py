"""Word lists, maps and limits that decide the results."""

# --- Fixed values: listings ---

UNREAD_COLUMNS = ["description", "url", "region_url", "image_url"]
DROPPED_COLUMNS = ["county", "size"]
UNKNOWN_COLUMNS = [
    "cylinders", "condition", "drive", "paint_color", "type",
    "manufacturer", "model", "title_status", "fuel", "transmission",
]
NEAR_DUPLICATE_KEYS = ["manufacturer", "model", "year", "odometer", "price"]

MISSING_DECISIONS = {
    "county": "drop column",
    "size": "drop column",
    "price": "drop rows",
    "year": "drop rows",
    "odometer": "drop rows",
    "cylinders": "keep as unknown",
    "condition": "keep as unknown",
    "drive": "keep as unknown",
    "paint_color": "keep as unknown",
    "type": "keep as unknown",
    "manufacturer": "keep as unknown",
    "model": "keep as unknown",
    "title_status": "keep as unknown",
    "fuel": "keep as unknown",
    "transmission": "keep as unknown",
    "VIN": "keep (identifier, left empty)",
    "lat": "keep (not used)",
    "long": "keep (not used)",
    "posting_date": "keep (not used)",
}
COMPLETE_DECISION = "keep (complete)"

PRICE_RANGE = (500, 200000)
YEAR_RANGE = (1990, 2022)
ODOMETER_MAX = 400000

LUXURY_BRANDS = [
    "acura", "alfa-romeo", "aston-martin", "audi", "bmw", "cadillac", "ferrari",
    "infiniti", "jaguar", "land rover", "lexus", "lincoln", "mercedes-benz",
    "porsche", "rover", "tesla", "volvo",
]
SEGMENTS = {
    "fuel": ["gas", "diesel"],
    "transmission": ["automatic", "manual"],
    "drive": ["fwd", "rwd", "4wd"],
}
ERA_EDGES = [1989, 1999, 2009, 2019, 2022]
ERA_LABELS = ["1990-1999", "2000-2009", "2010-2019", "2020-2022"]
BASELINES = {
    "type": "sedan", "fuel": "gas", "transmission": "automatic", "drive": "fwd",
    "brand_segment": "Standard", "model_grouped": "Other",
}
FEATURE_GROUP_NAMES = {
    "type": "Body type", "fuel": "Fuel type", "transmission": "Transmission", "drive": "Drive type",
    "brand_segment": "Brand segment", "model_grouped": "Vehicle model",
}

# --- Fixed values: spellings of a missing value in a CSV file (pandas' default list) ---

MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: recalls ---

LEGAL_SUFFIXES = ["inc", "corp", "corporation", "ltd", "llc", "co", "company", "limited", "incorporated"]

MANUFACTURER_GROUPS = {
    "General Motors": r"^general motors",
    "Ford": r"^ford motor",
    "Chrysler (FCA)": r"^chrysler|^fca us|^daimlerchrysler",
    "Toyota": r"^toyota",
    "Honda": r"^honda|^american honda",
    "Nissan": r"^nissan",
    "Volkswagen Group": r"^volkswagen|^audi",
    "BMW": r"^bmw",
    "Mercedes-Benz": r"^mercedes benz",
    "Hyundai": r"^hyundai motor",
    "Kia": r"^kia",
    "Mazda": r"^mazda",
    "Subaru": r"^subaru",
    "Mitsubishi": r"^mitsubishi motors",
    "Volvo Cars": r"^volvo car",
    "Jaguar Land Rover": r"^jaguar|^land rover",
    "Porsche": r"^porsche",
    "Tesla": r"^tesla",
    "Ferrari": r"^ferrari",
    "Aston Martin": r"^aston martin",
    "Harley-Davidson": r"^harley davidson",
}

BRAND_GROUPS = {
    "buick": "General Motors", "cadillac": "General Motors", "chevrolet": "General Motors",
    "gmc": "General Motors", "pontiac": "General Motors", "saturn": "General Motors",
    "ford": "Ford", "lincoln": "Ford", "mercury": "Ford",
    "chrysler": "Chrysler (FCA)", "dodge": "Chrysler (FCA)", "jeep": "Chrysler (FCA)",
    "ram": "Chrysler (FCA)", "fiat": "Chrysler (FCA)", "alfa-romeo": "Chrysler (FCA)",
    "toyota": "Toyota", "lexus": "Toyota",
    "honda": "Honda", "acura": "Honda",
    "nissan": "Nissan", "infiniti": "Nissan", "datsun": "Nissan",
    "volkswagen": "Volkswagen Group", "audi": "Volkswagen Group",
    "bmw": "BMW", "mini": "BMW",
    "mercedes-benz": "Mercedes-Benz",
    "hyundai": "Hyundai", "kia": "Kia", "mazda": "Mazda", "subaru": "Subaru",
    "mitsubishi": "Mitsubishi", "volvo": "Volvo Cars",
    "jaguar": "Jaguar Land Rover", "land rover": "Jaguar Land Rover", "rover": "Jaguar Land Rover",
    "porsche": "Porsche", "tesla": "Tesla", "ferrari": "Ferrari",
    "aston-martin": "Aston Martin", "harley-davidson": "Harley-Davidson",
}

BOILERPLATE_WORDS = [
    "increasing", "increase", "increases", "increased", "risk", "result", "resulting",
    "vehicle", "vehicles", "crash", "injury", "condition", "occur", "possibly",
    "possible", "personal", "cause", "causing", "warning", "accident", "event",
]
HIGH_SEVERITY_TERMS = [
    "fire", "burn", "explo", "death", "fatal", "loss of control",
    "loss of vehicle control", "loss of steering", "loss of brak",
    "brake failure", "rollaway", "roll away", "stall",
    "loss of drive power", "loss of motive power", "unintended",
]
MEDIUM_SEVERITY_TERMS = ["crash", "collision", "accident", "injur"]
AMBIGUOUS_TOKENS = [
    "", "unknown", "other", "new", "super", "grand", "sport", "base", "limited", "town", "land",
]
MODEL_YEAR_RANGE = (1980, 2027)
MAX_YEAR_SPAN = 30

QUALITY_OUT_OF_SCOPE = "Out of scope (tire / equipment / child seat)"
QUALITY_MODEL = "High (Mfr + Year + Model)"
QUALITY_YEAR = "Medium (Mfr + Year)"
QUALITY_MAKER = "Low (Mfr only)"
QUALITY_NONE = "Unmatched (manufacturer not in the listings)"

# --- Fixed values: decoded specifications ---

SPEC_FIELDS = {
    "VIN": "VIN",
    "Make": "API_Make",
    "Model": "API_Model",
    "ModelYear": "API_Year",
    "BodyClass": "API_Body",
    "DisplacementL": "API_Engine",
    "DriveType": "API_Drive",
    "FuelTypePrimary": "API_Fuel",
    "ErrorCode": "API_ErrorCode",
}
VALID_VIN = r"^[A-HJ-NPR-Z0-9]{17}$"
MAKE_ALIASES = {"rover": "land rover", "ram": "dodge"}
DRIVE_TERMS = [("4wd", ["4WD", "AWD", "4X4"]), ("fwd", ["FWD"]), ("rwd", ["RWD"]), ("2wd", ["4X2", "2WD"])]
FUEL_NAMES = {"Gasoline": "gas", "Diesel": "diesel", "Electric": "electric"}

# --- Fixed values: telematics ---

TRIP_BREAK_SECONDS = 120
GAP_SECONDS = 10
ROLLING_ROWS = 10
HARSH_MS2 = 3.0
SIGNAL_LABELS = {
    "speed": "OBD speed (km/h)",
    "gps_speed": "GPS speed (km/h)",
    "rpm": "Engine RPM",
    "x": "Accelerometer X (normalized, -1 to 1)",
}
