"""Files that are known by their name, and some by their first bytes, alone."""

from __future__ import annotations

from .base import reads

ZIP = b"PK\x03\x04"
SQUASHFS = (b"hsqs", b"sqsh")
NSIS = b"Nullsoft.NSIS.exehead"
HEAD = 8192

#: Datasource, type, expression over paths.
BY_NAME = (
    ("java_jar", "jar", r"(?i)\.jar$"),
    ("ant_ivy_xml", "ivy", r"(?i)(?:^|/)ivy\.xml$"),
    ("java_war_archive", "war", r"(?i)\.war$"),
    ("java_war_web_xml", "war", r"(?i)(?:^|/)WEB-INF/web\.xml$"),
    ("java_ear_archive", "ear", r"(?i)\.ear$"),
    ("java_ear_application_xml", "ear", r"(?i)(?:^|/)META-INF/application\.xml$"),
    ("axis2_module_xml", "axis2", r"(?i)(?:^|/)META-INF/module\.xml$"),
    ("axis2_mar", "axis2", r"(?i)\.mar$"),
    ("jboss_sar", "jboss-service", r"(?i)\.sar$"),
    ("jboss_service_xml", "jboss-service", r"(?i)(?:^|/)META-INF/jboss-service\.xml$"),
    ("meteor_package", "meteor", r"(?i)(?:^|/)package\.js$"),
    ("android_aar_library", "android_lib", r"(?i)\.aar$"),
    ("mozilla_xpi", "mozilla", r"(?i)\.xpi$"),
    ("chrome_crx", "chrome", r"(?i)\.crx$"),
    ("ios_ipa", "ios", r"(?i)\.ipa$"),
    ("microsoft_cabinet", "cab", r"(?i)\.cab$"),
    ("shar_shell_archive", "shar", r"(?i)\.shar$"),
    ("apple_dmg", "dmg", r"(?i)\.(?:dmg|sparseimage)$"),
    ("iso_disk_image", "iso", r"(?i)\.(?:iso|udf|img)$"),
)
#: Datasource, type, expression over paths, test of the content.
BY_CONTENT = (
    ("android_apk", "android", r"(?i)\.apk$", lambda c: c.startswith(ZIP)),
    ("squashfs_disk_image", "squashfs", r"(?i)\.(?:squashfs|sqsh|sfs|snap|img)$", lambda c: c[:4] in SQUASHFS),
    ("nsis_installer", "nsis", r"(?i)\.exe$", lambda c: NSIS in c[:HEAD]),
    ("installshield_installer", "installshield", r"(?i)\.exe$", lambda c: c.startswith(ZIP)),
)

for _name, _type, _paths in BY_NAME:
    reads(_name, _type, _paths, "none", None, f"{_type} by name")(lambda path, _: {})


def _by_content(test):
    return lambda path, content: {} if test(content) else []


for _name, _type, _paths, _test in BY_CONTENT:
    reads(_name, _type, _paths, "bytes", None, f"{_type} by name and first bytes")(_by_content(_test))
