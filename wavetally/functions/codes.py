"""Labels of alert originators and events."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public SAME originator and event codes with their labels.
ORIGINATORS = {
    "EAS": "Emergency Alert System",
    "CIV": "Civil authorities",
    "WXR": "National Weather Service",
    "PEP": "Primary Entry Point (national)",
    "EAN": "Emergency Action Notification",
}
EVENTS = {
    "EAN": "Emergency Action Notification", "EAT": "Emergency Action Termination", "NIC": "National Information Center",
    "NPT": "National Periodic Test", "RMT": "Required Monthly Test", "RWT": "Required Weekly Test",
    "NMN": "Network Message Notification", "TOR": "Tornado Warning", "SVR": "Severe Thunderstorm Warning",
    "FFW": "Flash Flood Warning", "FLW": "Flood Warning", "SMW": "Special Marine Warning", "SQW": "Snow Squall Warning",
    "EWW": "Extreme Wind Warning", "BZW": "Blizzard Warning", "IBW": "Ice Storm Warning", "WSW": "Winter Storm Warning",
    "HWW": "High Wind Warning", "HUW": "Hurricane Warning", "TRW": "Tropical Storm Warning", "SSW": "Storm Surge Warning",
    "TSW": "Tsunami Warning", "DSW": "Dust Storm Warning", "FRW": "Fire Warning", "AVW": "Avalanche Warning",
    "CFW": "Coastal Flood Warning", "CDW": "Civil Danger Warning", "LEW": "Law Enforcement Warning",
    "HMW": "Hazardous Materials Warning", "NUW": "Nuclear Power Plant Warning", "RHW": "Radiological Hazard Warning",
    "SPW": "Shelter In Place Warning", "VOW": "Volcano Warning", "EQW": "Earthquake Warning", "TOA": "Tornado Watch",
    "SVA": "Severe Thunderstorm Watch", "FFA": "Flash Flood Watch", "FLA": "Flood Watch", "BZA": "Blizzard Watch",
    "WSA": "Winter Storm Watch", "HWA": "High Wind Watch", "HUA": "Hurricane Watch", "TRA": "Tropical Storm Watch",
    "SSA": "Storm Surge Watch", "TSA": "Tsunami Watch", "CFA": "Coastal Flood Watch", "AVA": "Avalanche Watch",
    "SVS": "Severe Weather Statement", "SPS": "Special Weather Statement", "FFS": "Flash Flood Statement",
    "FLS": "Flood Statement", "HLS": "Hurricane Statement", "WSV": "Winter Weather Statement",
    "EVI": "Evacuation Immediate", "CEM": "Civil Emergency Message", "LAE": "Local Area Emergency",
    "ADR": "Administrative Message", "BLU": "Blue Alert", "CAE": "Child Abduction Emergency", "DMO": "Practice/Demo Warning",
}
#: Counties by five-digit code; users supply the rest (no table is available offline).
COUNTIES = {"18035": "Delaware County, IN", "18057": "Hamilton County, IN"}


def lookup(table: dict, key: Column) -> Column:
    """The table's value for the key; null without one."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def event_label(code: Column) -> Column:
    return F.coalesce(lookup(EVENTS, F.upper(code)), code)


def originator_label(code: Column) -> Column:
    return F.coalesce(lookup(ORIGINATORS, F.upper(code)), code)


def county(code: Column, counties: dict[str, str] | None = None) -> Column:
    """The county of a six-digit location code, whose first digit names a part of it."""
    return F.when(F.length(code) == 6, lookup(counties or COUNTIES, F.substring(code, 2, 5)))
