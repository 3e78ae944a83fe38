from tideline.streaming.markers import start_marker_sink, stream_markers

__all__ = ["start_marker_sink", "stream_markers"]
