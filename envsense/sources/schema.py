"""Row types of packets, clips, calibration and variants (Spark DDL)."""

PACKET = """
    timestamp bigint, device_id string,
    magnetometer struct<x:double,y:double,z:double,magnitude:double>,
    accelerometer struct<x:double,y:double,z:double>,
    gyroscope struct<x:double,y:double,z:double>,
    orientation struct<roll:double,pitch:double,yaw:double>,
    audio_peak double, humanoid_detected boolean, bluetooth_devices_count int, battery_level int, _corrupt_record string
"""
SENSORS_CSV = "magnetic_magnitude double, accel_x double, accel_y double, accel_z double, gyro_x double, gyro_y double, gyro_z double, orientation_yaw double, audio_peak double, humanoid_detected boolean, bluetooth_count int"
CALIBRATION = "device_id string, sensor string, offset_x double, offset_y double, offset_z double, scale_x double, scale_y double, scale_z double, timestamp bigint, calibrated boolean"
VARIANT = "variant string, anomaly boolean, confidence double, features map<string,double>, metadata map<string,string>, error string"
