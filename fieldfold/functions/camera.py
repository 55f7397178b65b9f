"""Pinhole camera over flat ground: focal length, attitude, rays to the ground and back."""

from __future__ import annotations

from .mathx import COLUMN

#: Beyond this slant range a ray counts as not hitting the ground.
MAX_RANGE = 1000.0


def focal_px(width, height, fov_deg, fov_type, m=COLUMN):
    """Focal length in pixels for a field of view across ("horizontal"), up ("vertical") or along the diagonal."""
    across, up = width * 0.5, height * 0.5
    half = m.where(fov_type == "horizontal", across, m.where(fov_type == "vertical", up, m.hypot(across, up)))
    return half / m.tan(m.radians(fov_deg) / 2.0)


def attitude(heading, pitch, roll, m=COLUMN):
    """Unit vectors right, down, forward of the camera in east-north-up, each a tuple of three."""
    ps, th, ro = m.radians(heading), m.radians(pitch), m.radians(roll)
    sp, cp, st, ct, sr, cr = m.sin(ps), m.cos(ps), m.sin(th), m.cos(th), m.sin(ro), m.cos(ro)
    right = (cp, -sp, cp * 0.0)
    down = (st * sp, st * cp, -ct)
    forward = (ct * sp, ct * cp, st)
    turned = tuple(cr * a + sr * b for a, b in zip(right, down, strict=True))
    sunk = tuple(cr * b - sr * a for a, b in zip(right, down, strict=True))
    return turned, sunk, forward


def cast(u, v, cx, cy, focal, height, axes, m=COLUMN, max_range: float = MAX_RANGE):
    """(east offset, north offset, valid) of the ground point that pixel (u, v) shows."""
    right, down, forward = axes
    a, b = (u - cx) / focal, (v - cy) / focal
    x, y, z = (a * r + b * d + f for r, d, f in zip(right, down, forward, strict=True))
    length = m.sqrt(x * x + y * y + z * z)
    slope = z / length
    falls = slope < -1e-6
    reach = -height / m.where(falls, slope, m.number(-1.0))
    return x / length * reach, y / length * reach, falls & (reach <= max_range)


def project(east, north, height, cx, cy, focal, axes, m=COLUMN):
    """(u, v, in front) of a ground point at an offset from the camera."""
    right, down, forward = axes
    along = lambda axis: east * axis[0] + north * axis[1] - height * axis[2]
    depth = along(forward)
    front = depth > 1e-9
    safe = m.where(front, depth, m.number(1.0))
    return along(right) / safe * focal + cx, along(down) / safe * focal + cy, front


def in_image(u, v, width, height, margin=0.0):
    """Lower bounds are inside, upper ones not."""
    return (u >= margin) & (v >= margin) & (u < width - margin) & (v < height - margin)
