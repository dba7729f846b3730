"""Explicit schemas of the inputs."""

# Column names and types of the feeds.
POSITION = "trip_id string, locationtime long, lat double, lon double, vehicle_id string"
STOP_TIMES = "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int"
STOPS = "stop_id string, stop_lon double, stop_lat double"
TRIPS = "trip_id string, service_id string, route_id string, shape_id string, block_id string"
FEED = (
    "file string, entity array<struct<id: string, vehicle: struct<trip: struct<trip_id: string>,"
    " position: struct<latitude: float, longitude: float>, timestamp: long, vehicle: struct<id: string>>>>"
)
LOCATION = "time long, longitude double, latitude double, altitudeAboveMeanSeaLevel double, bearing double, speed double"
ACCELEROMETER = "time long, y double"
ORIENTATION = "time long, pitch double"
GNSS = ("day", "time", "lat", "lon", "elev_m", "Q", "ns", "sdn", "sde", "sdu", "sdne", "sdeu", "sdun", "age", "ratio")
