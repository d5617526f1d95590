"""Constants of the fleet rules. Fixed values; each is stated once and used everywhere."""

from __future__ import annotations

FUEL_PRICE = 1.2
IDLE_LITRES_PER_HOUR = 0.5
DEFAULT_EFFICIENCY = 15.0
VEHICLE_PRICE = 30000
DEPOT = (40.7128, -74.0060)
CO2_KG_PER_LITRE = {"Gasoline": 2.31, "Diesel": 2.68, "Hybrid": 1.85, "Electric": 0.0}
KWH_PER_LITRE = {"Gasoline": 8.9, "Diesel": 10.7}
GRID_CO2_PER_KM = 0.2
WEATHER_FACTOR = {"Clear": 1.0, "Rain": 0.95, "Snow": 0.85, "Fog": 0.9, "Windy": 0.92}
ROAD_FACTOR = {"Urban": 0.85, "Highway": 1.1, "Mixed": 1.0, "Rural": 0.95, "Mountain": 0.8}
# Expected km/L: a row for each class, a column for each engine.
EXPECTED_EFFICIENCY = {
    "Compact": {"Gasoline": 18.0, "Diesel": 22.0, "Hybrid": 25.0, "Electric": 100.0},
    "Midsize": {"Gasoline": 15.0, "Diesel": 18.0, "Hybrid": 22.0, "Electric": 100.0},
    "SUV": {"Gasoline": 12.0, "Diesel": 15.0, "Hybrid": 20.0, "Electric": 100.0},
    "Truck": {"Gasoline": 10.0, "Diesel": 13.0, "Hybrid": 18.0, "Electric": 100.0},
}
# Benchmark km/L where no displacement range fits; 12 otherwise.
DEFAULT_BENCHMARK = {
    "Compact": {"Gasoline": 16.0, "Hybrid": 21.0, "Diesel": 18.0},
    "Midsize": {"Gasoline": 13.5, "Hybrid": 19.0, "Diesel": 15.0},
    "SUV": {"Gasoline": 11.0, "Hybrid": 17.0, "Diesel": 13.0},
    "Truck": {"Gasoline": 8.5, "Diesel": 10.5},
}
WEIGHT_EDGES = ([0, 2500, 3500, 4500, 5500, 10000], ["Light", "Medium-Light", "Medium", "Medium-Heavy", "Heavy"])
WEIGHT_KG = {"Light": 1500, "Medium-Light": 2000, "Medium": 2500, "Medium-Heavy": 3000, "Heavy": 3500}
WEIGHT_CLASSES = ((3000, "Compact"), (4000, "Midsize"), (5000, "SUV"), (7000, "Truck"))
EFFICIENCY_EDGES = ([0, 800, 1200, 2000, 5000], ["Low", "Medium", "High", "Very High"])
BENCHMARKS = (
    ("Compact", "Gasoline", "1.0-1.5L", 16.0), ("Compact", "Gasoline", "1.5-2.0L", 14.5), ("Compact", "Hybrid", "1.5-2.0L", 21.0),
    ("Midsize", "Gasoline", "2.0-2.5L", 13.5), ("Midsize", "Gasoline", "2.5-3.0L", 12.5), ("Midsize", "Hybrid", "2.0-2.5L", 19.0),
    ("SUV", "Gasoline", "2.5-3.0L", 11.0), ("SUV", "Gasoline", "3.0-3.5L", 10.0), ("SUV", "Hybrid", "2.5-3.0L", 17.0),
    ("Truck", "Gasoline", "3.5-4.0L", 8.5), ("Truck", "Diesel", "3.0-3.5L", 10.5),
)
CRITICAL_FAULTS = ("P0300", "P0301", "P0302", "P0303", "P0304")
WARNING_FAULTS = ("P0420", "P0171", "P0172", "P0442")
# Urgency: points for each fault; from which value on, and with what weight, percents of lost efficiency and minutes of idling count; least points of each level.
URGENCY_POINTS = {"fault": 10, "loss": (10, 2), "idle": (10, 0.5)}
URGENCY_LEVELS = ((30, "IMMEDIATE"), (15, "HIGH"), (5, "MEDIUM"))
URGENCY_LOWEST = "LOW"
