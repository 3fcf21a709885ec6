"""Part of skein: arrays of one frame, one chunk of frames or one camera, for work inside one grouped task."""
